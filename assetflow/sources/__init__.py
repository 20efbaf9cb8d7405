"""sources of assetflow."""

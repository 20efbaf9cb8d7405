"""streaming of assetflow."""

"""operators of assetflow."""

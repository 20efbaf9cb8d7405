"""functions of assetflow."""

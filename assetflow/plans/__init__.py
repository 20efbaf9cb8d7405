"""plans of assetflow."""

"""assetflow: semantic retrieval over large catalogues of digital assets, as Spark DataFrame operators."""

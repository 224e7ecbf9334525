"""watchloom: watch-list entity resolution and analytics expressed as Spark DataFrame plans."""

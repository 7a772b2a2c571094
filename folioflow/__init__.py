"""Document analytics on Spark: search, layout, comparison, change feeds and page documents as DataFrame transformations."""

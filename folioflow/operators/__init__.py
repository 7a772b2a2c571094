"""DataFrame operators: search, layout, comparison, pages, trees, annotations, recognition and caches."""

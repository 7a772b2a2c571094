"""Column functions: text, geometry, measures, colours and page-document functions."""

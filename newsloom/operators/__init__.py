"""DataFrame -> DataFrame operators of the article flow."""

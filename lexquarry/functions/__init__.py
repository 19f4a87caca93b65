"""Column functions: text normalisation, predicates, quality and relevance scores."""

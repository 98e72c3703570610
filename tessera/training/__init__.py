"""Training of the reranker and admission of dictionary layers."""

"""The morphological analyzer: model tables, lattice, decoder, correction rules, selection, public functions."""

"""Operators for corpora: clusters, similar vectors, tokens, mixtures and personal information. Nothing outside imports this package."""

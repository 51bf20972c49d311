"""Imports every module that registers queries."""

from __future__ import annotations

from .operators import acceptance, books, corpus, glossary, index_sync, library, note_contract, pages, resume, retrieval, semantic_notes, state, stores, structure, text_metrics, translation, trigram_index, vector_index, xhtml  # noqa: F401
from .plans import packs, scalars  # noqa: F401
from .streaming import leases, windows  # noqa: F401

FLAGSHIP = "rrf_hybrid"

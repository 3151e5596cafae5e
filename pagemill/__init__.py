"""Stored web pages to clean text corpora, as Spark jobs."""

from pagemill.operators.frontier import breadth_first
from pagemill.operators.merge import merged_documents, page_docs, segments
from pagemill.options import CorpusOptions
from pagemill.plans.convert import to_markdown
from pagemill.plans.corpus import Corpus, build_corpus
from pagemill.sources.html import node_rows, shred

__version__ = "1.0.0"

__all__ = [
    "Corpus", "CorpusOptions", "breadth_first", "build_corpus", "merged_documents", "node_rows",
    "page_docs", "segments", "shred", "to_markdown",
]

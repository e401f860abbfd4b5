"""spindex — a search-corpus toolkit expressed as Spark DataFrame jobs.

Layers:
  functions/  Column-level helpers (tokenizers, URL and HTML helpers, scoring)
  sources/    readers for the input tables and derived fixtures
  operators/  DataFrame -> DataFrame operators (index, search, links, ...)
  plans/      end-to-end compositions (ingest, index build, search, frontier)
  streaming/  incremental versions on Structured Streaming
"""

from spindex.session import ensure_checkpoint_dir, get_spark, materialize  # noqa: F401
from spindex.operators.index import build_index  # noqa: F401
from spindex.operators.search import search  # noqa: F401
from spindex.plans.frontier import prepare_frontier  # noqa: F401
from spindex.plans.index_build import build_search_index  # noqa: F401
from spindex.plans.ingest import empty_graph, ingest  # noqa: F401
from spindex.plans.search import search_index  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir", "materialize", "build_index", "search",
           "prepare_frontier", "build_search_index", "ingest", "empty_graph", "search_index"]

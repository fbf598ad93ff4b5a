"""What users call, in one place."""

from .functions.printf import format_message, register_names
from .kb import KnowledgeBase, KnowledgeBaseError, lint_labels, load_kb, render_signature
from .operators.annotate import annotate
from .operators.compare import compare_files, custody, full_outer, read_reference, tree_digest
from .operators.diff import IdentifyResults, compare_to_baseline
from .operators.export import run_export
from .operators.filters import LogFilters, apply_filters
from .operators.query import LogStore, count_logs, fetch_context, fetch_logs, query_logs
from .operators.summary import Summary, summarise
from .plans.workflow import annotate_case, clear_annotations, open_or_extract, run_extract, run_identify, validate, validate_acquisition, verify_case
from .session import session
from .sources.containers import detect, loose_dirs, prepare
from .sources.datasource import register
from .sources.ingest import read_archive
from .store import CaseStore, IncompleteCaseError, InvalidCaseError

__all__ = [n for n in dir() if not n.startswith("_")]

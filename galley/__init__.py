"""Distributed copy-edit and translation dataflows on PySpark DataFrames."""

from galley.api import plan_folder, polish, rewrite_documents, rewrite_folder, rewrite_segments
from galley.plans.run import Options, run
from galley.sources.reader import read_files, read_folder, read_segments
from galley.sources.sinks import as_format, write_document, write_files

__version__ = "0.2.0"
__all__ = ["Options", "as_format", "plan_folder", "polish", "read_files", "read_folder", "read_segments", "rewrite_documents", "rewrite_folder", "rewrite_segments", "run", "write_document", "write_files"]

"""The engine's surface: process, generate, compile, packages."""

from arborq.functions.register import document_json, register
from arborq.operators.parse import Corpus, parse
from arborq.operators.process import diagnostics, process, verdicts
from arborq.operators.project import Projection, project
from arborq.operators.rss import rss_item_count, rss_report, rss_warnings
from arborq.operators.tokens import tokens
from arborq.operators.tree import coalesce_text, escape_attribute, escape_text, gather_text, generate
from arborq.plans.formats import format_schema
from arborq.plans.schema import CompileReply, Registry, Schema, compile_dtd, compile_ebnf, compile_schema, compile_source, compile_xsd, file_resolver
from arborq.sources.packages import parts_of, process_packages, read_packages, relationships
from arborq.sources.text import read_documents
from arborq.streaming.documents import process_stream, verdict_counts

__all__ = [
    "CompileReply", "Corpus", "Projection", "Registry", "Schema", "coalesce_text", "compile_dtd", "compile_ebnf", "compile_schema", "compile_source",
    "compile_xsd", "diagnostics", "document_json", "escape_attribute", "escape_text", "file_resolver", "format_schema", "gather_text", "generate", "parse",
    "parts_of", "process", "process_packages", "process_stream", "project", "read_documents", "read_packages", "register", "relationships", "rss_item_count",
    "rss_report", "rss_warnings", "tokens", "verdict_counts", "verdicts",
]

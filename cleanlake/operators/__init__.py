"""The operators of the sanitizer: what a user calls, by module."""

from .crawl import answers, enqueue, redirect_actions, redirect_failures, redirect_owners, running_bytes, sanitize_responses
from .crawl import crawl as crawl_resources
from .html import LOCAL_BASE, Sanitized, first_error_cutoff, sanitize_html, sanitize_rows
from .local import SanitizedFiles, sanitize_files
from .policy import LimitRule, Policy, ReplaceRule, dump_default, load_policy
from .remote import RemotePages, fetch_subresources, resource_actions, sanitize_pages
from .report import any_error, latency, log_lines, rates, reports, rules_of, speedup, summary, verdicts

__all__ = [
    "LOCAL_BASE", "LimitRule", "Policy", "RemotePages", "ReplaceRule", "Sanitized", "SanitizedFiles", "answers", "any_error", "crawl_resources", "dump_default", "enqueue", "fetch_subresources",
    "first_error_cutoff", "latency", "load_policy", "log_lines", "rates", "redirect_actions", "redirect_failures", "redirect_owners", "reports", "resource_actions", "rules_of", "running_bytes",
    "sanitize_files", "sanitize_html", "sanitize_pages", "sanitize_responses", "sanitize_rows", "speedup", "summary", "verdicts",
]

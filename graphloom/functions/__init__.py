"""Scalar functions on columns, in one place."""

from __future__ import annotations

from ..model import local_name, namespace, node_display, value_display, value_text
from ..operators.graph import compact, expand
from ..operators.learning import linear_value, td_target
from ..operators.memory import coverage, decayed, embed, passage, question_terms
from ..operators.risk import level
from ..operators.similarity import cosine, jaro_winkler, levenshtein_similarity, normalize_name, sound_code
from ..operators.vault import basename, cloze, frontmatter_tags, inline_tags, mentions, neutralize, parse_task, strip_brackets, valid_date, wikilinks, without_extension

__all__ = [
    "basename", "cloze", "compact", "cosine", "coverage", "decayed", "embed", "expand", "frontmatter_tags", "inline_tags", "jaro_winkler", "level", "levenshtein_similarity", "linear_value",
    "local_name", "mentions", "namespace", "neutralize", "node_display", "normalize_name", "parse_task", "passage", "question_terms", "sound_code", "strip_brackets", "td_target", "valid_date",
    "value_display", "value_text", "wikilinks", "without_extension",
]

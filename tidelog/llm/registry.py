"""The queries of this package, one an operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_text, jaccard_join, licenses, lines, mixing, quality_knn, quality_rules, secrets, token_counts

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_html_text": html_text.op6_html_text,
    "op7_quality_classifier": quality_knn.op7_quality_classifier,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_secret_scan": secrets.op10_secret_scan,
}

#: Operator 3's rows need windows at every place, 5's an iteration to a fixed point, 7's a decomposition,
#: 9's a closure over links, 2's and 10's a tokenizer, 6's a parser and 8's an index of templates: their tests
#: hold them against brute force.
SQL = {
    "op1_mix_sources": mixing.SQL,
    "op4_line_dedup": lines.SQL,
}

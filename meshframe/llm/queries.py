"""Queries opN_<name> over the documents table, and DuckDB SQL where SQL can express them."""

from .exact_dedup import op1_exact_dedup
from .filter_audit import audit_sql, op11_filter_audit
from .line_dedup import dedup_sql, op2_line_dedup
from .lm import op4_lm_scores
from .packing import op9_packing
from .periodic_runs import op12_periodic_runs
from .quality_gam import op7_quality_gam
from .quality_rules import op6_quality_rules
from .rotated_codes import op13_nearest
from .simhash import op3_simhash
from .sp_lattice import op8_sentencepiece
from .token_count import op10_token_counts
from .token_store import op5_token_files

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_lm_scores": op4_lm_scores,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_gam": op7_quality_gam,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_nearest": op13_nearest,
}

EXACT_SQL = """
with n as (select doc_id, coalesce(length(text), 0) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents),
g as (select text_sha256, arg_min(doc_id, (-n_chars, doc_id)) as keep_id, count(*) as group_size from n group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from n join g using (text_sha256)"""

ORACLE_SQL = {
    "op1_exact_dedup": EXACT_SQL,
    "op2_line_dedup": dedup_sql(),
    "op11_filter_audit": audit_sql(),
}

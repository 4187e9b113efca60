"""DuckDB SQL fragments shared by the oracle queries.

DuckDB's RE2 is ASCII for \\w, \\s and \\b, so Unicode classes are spelled
out; md5 draws use the same ``seed:key`` strings as the Spark side.
"""

from __future__ import annotations

# --- fixed values: DuckDB spellings of the Python regex classes ---
WS = r"[\t\n\v\f\r \x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def tokens(expr: str) -> str:
    return rf"list_filter(string_split_regex(lower({expr}), '[^\p{{L}}]+'), lambda x: x <> '')"


def draw(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) as bigint)"


def hkey(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def report(cells: str, group: list[str], digits: int = 6, rounded: bool = True) -> str:
    """SQL computing n + five metrics per group from a cells relation
    (group..., y_true, y_pred, n)."""
    g = "".join(f"{c}, " for c in group)
    gb = f"group by {', '.join(group)}" if group else ""
    r = (lambda e: f"round({e}, {digits})") if rounded else (lambda e: e)
    return f"""
  (with pc as (
     select {g}label, sum(support) support, sum(predicted) predicted, sum(tp) tp from (
       select {g}y_true label, n support, 0 predicted, case when y_true = y_pred then n else 0 end tp from {cells}
       union all
       select {g}y_pred label, 0 support, n predicted, 0 tp from {cells})
     group by {g}label),
   pm as (
     select {g}support, tp,
       coalesce(cast(tp as double) / nullif(predicted, 0), 0) p,
       coalesce(cast(tp as double) / nullif(support, 0), 0) r,
       coalesce(cast(2 * tp as double) / nullif(support + predicted, 0), 0) f1
     from pc)
   select {g}cast(sum(support) as bigint) n,
     {r("coalesce(cast(sum(tp) as double) / nullif(sum(support), 0), 0)")} accuracy,
     {r("coalesce(sum(support * p) / nullif(sum(support), 0), 0)")} "precision",
     {r("coalesce(sum(support * r) / nullif(sum(support), 0), 0)")} recall,
     {r("avg(f1)")} f1_macro,
     {r("coalesce(sum(support * f1) / nullif(sum(support), 0), 0)")} f1_weighted
   from pm {gb})"""


def lexicon_values(lexicon: dict[str, list[str]], labels: list[str]) -> str:
    rows = [f"('{w}', '{lab}', {i})" for i, lab in enumerate(labels) for w in lexicon[lab]]
    return "(values " + ", ".join(rows) + ") lex(token, label, idx)"


def label_list(labels: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in labels) + "]"


def round_sig(expr: str, digits: int = 9) -> str:
    e = f"pow(10.0, floor(log10(abs({expr}))))"
    return f"(case when {expr} = 0 then 0.0 else round({expr} / {e}, {digits - 1}) * {e} end)"

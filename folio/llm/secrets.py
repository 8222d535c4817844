"""Secret scan in DataFrame functions only: three fixed patterns, and sliding-window entropy.

Regex functions of Spark give matches but no positions. They follow from the pieces between
matches: a match starts after all pieces and matches before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds. Letters of the first are spelt in both cases.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters of an assigned value that make it a secret.
ASSIGN_MIN = 6


@dataclass(frozen=True)
class EntropyClass:
    """A character class whose runs of ``window`` or more are scanned; bits a character that mark a window."""

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float


#: Character classes. A random window lies above its bits, invented or real words below.
HEX_CLASS = EntropyClass("entropy_hex", "0123456789abcdefABCDEF", r"[0-9a-fA-F]{20,}", 20, 3.0)
BASE64_CLASS = EntropyClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"[A-Za-z0-9+/]{20,}", 20, 3.75)
#: Candidates that match one of these whole are no secrets: words, numbers, paths of words, samples.
#: No group is repeated, since that takes the JVM a stack frame a turn; each is linear in the candidate.
ALLOW = (r"[A-Za-z]+", r"[0-9]+", r"[A-Za-z]*/[A-Za-z/]*", r".*(EXAMPLE|example|xxxx|XXXX|0123456789|abcdefgh).*")
#: Matches summed at a time; start positions take time in proportion to matches x BLOCK.
BLOCK = 128


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL for array<struct<start, m>>: all matches with the code point where each starts, from 0."""
    p = _quoted(pattern)
    return f"""
    CASE WHEN {text} RLIKE {p} THEN
      element_at(transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'p', transform(split({text}, {p}, -1), x -> CAST(length(x) AS BIGINT)))), r ->
        element_at(transform(array(transform(r.m, (x, i) -> r.p[i] + length(x))), lens ->
          element_at(transform(array(transform(sequence(0, CAST((size(lens) - 1) DIV {BLOCK} AS INT)), b -> aggregate(slice(lens, b * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x))), sums ->
            element_at(transform(array(transform(sums, (x, b) -> aggregate(slice(sums, 1, b), 0L, (a, y) -> a + y))), bases ->
              transform(r.m, (x, i) -> named_struct('start',
                bases[CAST(i DIV {BLOCK} AS INT)] + aggregate(slice(lens, CAST(i DIV {BLOCK} AS INT) * {BLOCK} + 1, i % {BLOCK}), 0L, (a, y) -> a + y) + r.p[i], 'm', x))), 1)), 1)), 1)), 1)
    ELSE array() END"""


def _entropy(text: str, kind: EntropyClass, allow: tuple[str, ...]) -> str:
    """SQL for array<struct<start, stop>>: per candidate, the hulls of touching windows of ``bits`` or more.

    The sum of c * log2(c) over the window's symbol counts c is kept up to date as a character
    enters and one leaves, so a window costs no recount; entropy = log2(w) - sum / w.
    """
    w, alphabet = kind.window, _quoted(kind.alphabet)
    most = f"({w} * (log2(CAST({w} AS DOUBLE)) - {kind.bits}D))"
    part = lambda c: f"IF({c} > 1, {c} * log2(CAST({c} AS DOUBLE)), 0D)"
    allowed = " OR ".join(f"c.m RLIKE {_quoted('^(?:' + a + ')$')}" for a in allow) or "FALSE"
    state = lambda n="q.n", s="q.s", start="q.from", stop="q.to", out="q.out": f"named_struct('n', {n}, 's', {s}, 'from', {start}, 'to', {stop}, 'out', {out})"
    zero = state(f"array_repeat(0, {len(kind.alphabet)})", "0D", "-1L", "-1L", "CAST(array() AS ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>)")
    done = "IF(q.to >= 0, concat(q.out, array(named_struct('start', q.from, 'stop', q.to))), q.out)"
    # the character of number i enters; the one of number o leaves, or none (-1) while the window fills
    counts = "transform(q.n, (v, j) -> CASE WHEN j = i THEN v + 1 WHEN j = o THEN v - 1 ELSE v END)"
    total = f"q.s + {part('(q.n[i] + 1)')} - {part('q.n[i]')} + IF(o < 0, 0D, {part('(q.n[o] - 1)')} - {part('q.n[o]')})"
    moved = f"aggregate(array(codes[k]), a, (q, i) -> aggregate(array(IF(k >= {w}, codes[k - {w}], -1)), q, (q, o) -> IF(i = o, q, {state(counts, total)})))"
    mark = f"""element_at(transform(array({moved}), q -> CASE
        WHEN k < {w} - 1 OR q.s > {most} THEN q
        WHEN q.to >= k - {w} + 1 THEN {state(stop="k + 1L")}
        ELSE {state(start=f"k - {w} + 1L", stop="k + 1L", out=done)} END), 1)"""
    hulls = f"aggregate(sequence(0, size(codes) - 1), {zero}, (a, k) -> {mark}, q -> {done})"
    # characters become numbers once: to seek the k-th one of a string takes time in proportion to k
    numbers = f"transform(split(c.m, '', -1), x -> instr({alphabet}, x) - 1)"
    return f"flatten(transform(filter({_matches(text, kind.pattern)}, c -> NOT ({allowed})), c -> transform(element_at(transform(array({numbers}), codes -> {hulls}), 1), h -> named_struct('start', h.start + c.start, 'stop', h.stop + c.start))))"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = (HEX_CLASS, BASE64_CLASS), allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per input row: doc_id and found, an array of (kind, rank, start, stop) in order of start, then rank.

    start and stop are code points, stop exclusive. Matches of a kind are leftmost and don't
    overlap; kinds may. A null or empty text has none. Work is linear in the text; rows are
    independent, so nulls in other columns, repeated rows and clashing names change nothing, and an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the value is the match's last part: what is left after the sign, blanks and quote
    value = _quoted(r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?""")
    base = [
        ("assign", f"filter({_matches('text', ASSIGN)}, c -> length(regexp_replace(c.m, {value}, '')) >= {ASSIGN_MIN})"),
        ("access", f"IF(contains(text, 'AKIA'), {_matches('text', ACCESS)}, array())"),
        ("hex", _matches("text", HEX)),
    ]
    spans = [f"transform({sql}, c -> named_struct('start', c.start, 'rank', {k}, 'stop', c.start + length(c.m), 'kind', '{name}'))" for k, (name, sql) in enumerate(base)]
    spans += [f"transform({_entropy('text', c, allow)}, h -> named_struct('start', h.start, 'rank', {k}, 'stop', h.stop, 'kind', '{c.name}'))" for k, c in enumerate(classes, len(base))]
    return rows.select("doc_id", F.expr(f"array_sort(concat({', '.join(spans)}))").alias("found"))


def _joined(found: str, only: str) -> Column:
    return F.expr(f"array_join(transform(filter({found}, s -> {only}), s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')")


def op9(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.expr(f"CAST(size(filter(found, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("found", "s.rank < 3"), 256).alias("base_sha256"), _joined("found", "TRUE").alias("spans"))

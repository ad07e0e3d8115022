"""DuckDB SQL for the registered queries, written from the definitions.

Hashes here are XORs over a frame of k rows, not differences of a running XOR as in the engine; the
sampled position is a minimum over a frame of w rows.  All pieces are common table expressions.
"""

from __future__ import annotations

from seqloom.functions.hashers import CODE_STEP, FX32, MUL32, MUL64, NT32, NT64, SEED_STEP

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def dna(keep_n: bool = False) -> str:
    letters = "ACGTNacgtn" if keep_n else "ACGTacgt"
    return f"seqs AS (SELECT doc_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^{letters}]', '', 'g')) AS seq FROM documents)"


ASCII_TEXT = "seqs AS (SELECT doc_id AS seq_id, regexp_replace(coalesce(text, ''), '[^\\x20-\\x7E]', '', 'g') AS seq FROM documents)"


def bases(alphabet: str = "dna") -> str:
    letter = (
        "CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'T' THEN 2 ELSE 3 END"
        if alphabet == "dna"
        else "unicode(c)"
    )
    return f"""letters AS (
  SELECT seq_id, length(seq) AS n, unnest(range(length(seq))) AS pos, unnest(string_split(seq, '')) AS c FROM seqs WHERE length(seq) > 0),
bases AS (SELECT seq_id, n, pos, CAST({letter} AS BIGINT) AS letter, CAST(c NOT IN ('A', 'C', 'G', 'T') AS BIGINT) AS amb FROM letters)"""


def rotl(x: str, r: str, bits: int = 32) -> str:
    r = f"CAST(({r}) % {bits} AS INTEGER)"
    if bits == 32:
        return f"((({x} << {r}) & {M32}) | ({x} >> (32 - {r})))"
    mask = f"((CAST(1 AS HUGEINT) << (64 - {r})) - 1)"
    return f"((({x} & {mask}) << {r}) | ({x} >> (64 - {r})))"


def rotr(x: str, r: str) -> str:
    return rotl(x, f"32 - ({r}) % 32")


def _frame(rows: int) -> str:
    return f"OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {rows - 1} FOLLOWING)"


def _lead(x: str, j: int) -> str:
    return f"lead({x}, {j}) OVER (PARTITION BY seq_id ORDER BY pos)" if j else x


def _term(kind: str, letter: str, seed: int) -> str:
    if kind == "nt":
        term = f"CASE {letter} WHEN 0 THEN {NT32[0]} WHEN 1 THEN {NT32[1]} WHEN 2 THEN {NT32[2]} ELSE {NT32[3]} END"
        code = letter
    else:
        code = f"CASE {letter} WHEN 0 THEN CAST(65 AS BIGINT) WHEN 1 THEN 67 WHEN 2 THEN 84 ELSE 71 END" if kind == "mul" else letter
        term = f"(({code}) * {MUL32} & {M32})"
    term = f"CAST({term} AS BIGINT)"
    return f"xor({term}, CAST(({seed} * {SEED_STEP} + ({code}) * {CODE_STEP}) & {M32} AS BIGINT))" if seed else term


def kmers(kind: str, k: int, canonical: bool = False, seed: int = 0) -> str:
    """``kmers(seq_id, n, pos, letter, amb, h)``; kinds nt, mul, mul_text, antilex, nt64, mul64, fx."""
    if kind == "fx":
        packed = " + ".join(f"({_lead('letter', j)} << {2 * (k - 1 - j)})" for j in range(k))
        return f"kmers AS (SELECT *, (({packed}) * {FX32}) & {M32} AS h FROM bases)"
    if kind == "antilex":
        def order(backwards: bool) -> str:
            parts = []
            for j in range(min(k, 16)):
                code = f"xor({_lead('letter', k - 1 - j)}, 2)" if backwards else f"({_lead('letter', j)})"
                parts.append(f"({f'(3 - {code})' if j == 0 else code} << {30 - 2 * j})")
            return " + ".join(parts)

        h = f"({order(False)} + {order(True)}) & {M32}" if canonical else order(False)
        return f"kmers AS (SELECT *, {h} AS h FROM bases)"
    if kind in ("nt64", "mul64"):
        if kind == "nt64":
            term = "CASE letter " + " ".join(f"WHEN {ord(c)} THEN CAST('{t}' AS HUGEINT)" for c, t in NT64.items()) + " ELSE CAST(1 AS HUGEINT) END"
        else:
            term = f"(CAST(letter AS HUGEINT) * CAST('{MUL64}' AS HUGEINT)) & CAST('{M64}' AS HUGEINT)"
        x = rotl(f"({term})", "64 - pos % 64", 64)
        return f"""terms AS (SELECT *, {x} AS x FROM bases),
folded AS (SELECT *, bit_xor(x) {_frame(k)} AS f FROM terms),
kmers AS (SELECT seq_id, n, pos, letter, amb, {rotl('f', f'pos + {k - 1}', 64)} AS h FROM folded)"""
    other = "letter" if kind == "mul_text" else "xor(letter, 2)"
    forward, backward = rotr(_term(kind, "letter", seed), "7 * pos"), rotl(_term(kind, other, seed), "7 * pos")
    h = rotl("f", f"7 * (pos + {k - 1})")
    if canonical:
        h = f"({h} + {rotr('b', '7 * pos')}) & {M32}"
    return f"""terms AS (SELECT *, {forward} AS x, {backward} AS y FROM bases),
folded AS (SELECT *, bit_xor(x) {_frame(k)} AS f, bit_xor(y) {_frame(k)} AS b FROM terms),
kmers AS (SELECT seq_id, n, pos, letter, amb, {h} AS h FROM folded)"""


def windows(k: int, w: int, canonical: bool = False, skip: bool = False, full: str = "") -> str:
    """``chosen(seq_id, n, win, pos)``: the position sampled by each complete window."""
    length = k + w - 1
    if full:
        low, high = f"min((CAST(h AS HUGEINT) << 32) + pos) {_frame(w)} & {M32}", "0"
    else:
        low = f"min(((h >> 16) << 32) + pos) {_frame(w)} & {M32}"
        high = f"max(((65535 - (h >> 16)) << 32) + pos) {_frame(w)} & {M32}"
    pos = "CASE WHEN strand THEN l ELSE r END" if canonical else "l"
    return f"""found AS (
  SELECT seq_id, n, pos AS win, {low} AS l, {high} AS r, 2 * sum(CAST(letter & 2 > 0 AS BIGINT)) {_frame(length)} > {length} AS strand,
    sum(amb) {_frame(length)} AS n_amb FROM kmers),
chosen AS (SELECT seq_id, n, win, CAST({pos} AS BIGINT) AS pos, strand, n_amb FROM found WHERE win <= n - {length}{' AND n_amb = 0' if skip else ''})"""


def select(kind: str, k: int, w: int) -> str:
    """``picked(seq_id, ord, pos, sk_start, sk_end)``."""
    if kind == "minimizer":
        return f"""fresh AS (
  SELECT *, coalesce(lag(pos) OVER (PARTITION BY seq_id ORDER BY win) <> pos, true) AS fresh FROM chosen),
picked AS (
  SELECT seq_id, row_number() OVER s - 1 AS ord, pos, win AS sk_start, coalesce(lead(win) OVER s + {k + w - 2}, n) AS sk_end
  FROM fresh WHERE fresh WINDOW s AS (PARTITION BY seq_id ORDER BY win))"""
    rule = f"pos = win OR pos = win + {w - 1}" if kind == "closed" else f"pos = win + {w // 2}"
    return f"picked AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY win) - 1 AS ord, win AS pos FROM chosen WHERE {rule})"


def value(length: int, canonical: bool) -> str:
    """The value at ``pos`` of ``seq``: the first base in the lowest bits."""
    code = "CASE substr(seq, CAST({at} AS INTEGER), 1) WHEN 'A' THEN {a} WHEN 'C' THEN {c} WHEN 'T' THEN {t} ELSE {g} END"
    kind = "BIGINT" if length <= 31 else "HUGEINT"

    def total(at: str, codes: tuple[int, int, int, int]) -> str:
        digit = code.format(at=at, a=codes[0], c=codes[1], t=codes[2], g=codes[3])
        return f"list_sum(list_transform(range({length}), lambda j: CAST({digit} AS {kind}) << CAST(2 * j AS INTEGER)))"

    forward = total("pos + 1 + j", (0, 1, 2, 3))
    if not canonical:
        return forward
    return f"least({forward}, {total(f'pos + {length} - j', (2, 3, 0, 1))})"


def sketch(
    columns: str = "seq_id, ord, pos",
    k: int = 21,
    w: int = 11,
    kind: str = "minimizer",
    canonical: bool = False,
    skip: bool = False,
    hash: str = "nt",
    seed: int = 0,
    value_length: int = 0,
    source: str | None = None,
    alphabet: str = "dna",
) -> str:
    parts = [source or dna(keep_n=skip), bases(alphabet), kmers(hash, k, canonical, seed)]
    parts.append(windows(k, w, canonical, skip, full=hash if hash in ("nt64", "mul64", "fx") else ""))
    if kind == "window":
        return "WITH " + ",\n".join(parts) + "\nSELECT seq_id, win, pos FROM chosen"
    parts.append(select(kind, k, w))
    tail = f"SELECT {columns} FROM picked"
    if value_length:
        kind_ = "BIGINT" if value_length <= 31 else "VARCHAR"
        tail = f"SELECT {columns}, CAST({value(value_length, canonical)} AS {kind_}) AS value FROM picked JOIN seqs USING (seq_id)"
    return "WITH " + ",\n".join(parts) + "\n" + tail

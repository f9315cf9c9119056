"""Operator 5: personal data by candidates and gradient boosted trees.

DataFrame functions only. The four base kinds (email, ip, card, phone) are
found by regular expressions and checked; they always stay. High-recall
generators then propose further spans, overlapping or not: long tokens that
mix letters and digits (``secret``) and grouped numbers (``number``). Each
candidate is a cell of discrete features: its format, the character before it,
whether its format is a plain one (date, version, decimal, ...), and the class
of the word before it: one that announces a value ("token =", "iban"), one that
names something harmless ("commit", "order no"), or another.

Labels. No candidate of a corpus is labelled, so labels come from evidence and
are corrected for the rest (positive-unlabelled learning): an announced value
is a positive, one after a harmless word or of a plain format is a negative,
whatever stands before it. Any other is a positive by the share of positives
among the labelled values of its format, in which the unlabelled ones count
weakly as negatives (``UNLABELLED``): a format that is only ever announced keeps
its unannounced values as positives, one that commits share does not.

One aggregate counts candidates by (cell, fold): its rows are bounded by the
number of cells (CELLS), not by the corpus, so boosting, calibration (isotonic,
on the fold held out) and the threshold work on that table. A cell is selected
when its calibrated precision reaches ``PRECISION``; without trees, or without
announced values, nothing is added. Selected spans that touch a base span are
dropped; of touching ones a sweep in text order keeps the better.

Every pass over a text or its matches is linear. Regular expressions never go
back over a run of characters twice: runs are matched possessively and only
from their start (or from the end of the last match). Positions, overlaps and
redaction are running scans over arrays, in chunks of ``CHUNK`` so that no step
copies what came before. Positions count code points, end exclusive.

Edge cases: a null or empty text has no spans; ids may be null or repeat, each
row has its own row; extra columns are kept by ``redact`` and ignored by
``find``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expressions of the base kinds, as the plain ones but linear.
BASE: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
GENERATORS: dict[str, str] = {
    "number": r"(?<![0-9+])[0-9]++(?:[ ./-][0-9]++)++",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+",
}
ANNOUNCED = {
    "number": r"(?i)(?<![a-z])(?:ssn|iban|passport|account|acct|social security|tel|phone|fax|dob)(?: no| number)?\.?\s?[=:#]?\s?$",
    "secret": r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?$",
}
#: Words before a value that names something harmless.
HARMLESS = (r"(?i)(?<![a-z])(?:commit|sha|sha1|sha256|md5|checksum|digest|hash|revision|rev|version|ver|build|release|order|invoice|isbn|issn|doi|"
            r"page|pages|figure|fig|chapter|section|line|row|table|item|issue|ticket)(?: no| number| id)?\.?\s?[=:#]?\s?[\"']?$")
#: Formats that say what a value is: dates, years, times, versions and decimals; identifiers of one case joined by marks.
PLAIN = {
    "number": r"^(?:(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/.](?:0?[1-9]|1[0-2])"
              r"[-/.](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}|[0-9]{1,3}(?:\.[0-9]{1,3}){1,2}|[0-9]+\.[0-9]+|[0-9]{1,2}-[0-9]{1,2})$",
    "secret": r"^(?:[A-Z]{3,}|[a-z]{3,}|[0-9]{1,9})(?:[_-](?:[A-Z]{3,}|[a-z]{3,}|[0-9]{1,9}))+$",
}
CONTEXT = 32
FEATURES = (("kind", 2), ("length", 8), ("hex", 2), ("case", 3), ("digits", 4), ("before", 4), ("groups", 4), ("plain", 2), ("word", 3))
CELLS = math.prod(n for _, n in FEATURES)
CONTEXTS = FEATURES[-1][1]          # the word is the last digit of a cell
OTHER, ANNOUNCING, NAMING = range(CONTEXTS)
FOLDS = 5
ROUNDS, RATE, DEPTH = 60, 0.3, 3
PRECISION = 0.95
UNLABELLED, HIDDEN = 0.05, 0.5
CHUNK = 256
SPAN = "struct<s:int,e:int>"
CANDIDATE = "struct<s:int,e:int,cell:int>"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, start: Column, kind: str, step) -> Column:
    """struct(state, out): a running state over an array and the values that
    ``step(state, item)`` -> (state, value, whether to keep it) gives. Values
    are gathered in chunks, so nothing grows inside the inner loop."""
    none, nothing = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def inner(acc: Column, x: Column) -> Column:
        state, value, keep = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(keep, F.array_append(acc["out"], value)).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        one = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return once(one, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    def whole(own: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(own) - 1, F.lit(0)) / CHUNK).cast("int")),
                             lambda c: F.slice(own, c * CHUNK + 1, F.lit(CHUNK)))
        return F.aggregate(chunks, F.struct(start.alias("state"), nothing.alias("out")), outer,
                           lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))

    return once(items, whole)


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "secret":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def _cell(kind: str, hit: Column, before: Column) -> Column:
    """The candidate's cell: its features as digits of a mixed-radix number."""
    size = F.length(hit)
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    context = F.substring(before, -CONTEXT, CONTEXT)
    last = F.substring(before, -1, 1)
    values = {
        "kind": F.lit(list(GENERATORS).index(kind)), "length": F.least(size / 8, F.lit(7)).cast("int"),
        "hex": hit.rlike("^[0-9a-fA-F]+$").cast("int"), "case": hit.rlike("[a-z]").cast("int") + hit.rlike("[A-Z]").cast("int"),
        "digits": F.least(F.floor(digits * 4 / size), F.lit(3)).cast("int"),
        "before": F.when(last.isin('"', "'"), 1).when(last.isin("=", ":"), 2).when(last.rlike(r"\S"), 3).otherwise(0),
        "groups": F.least(size - F.length(F.regexp_replace(hit, "[ ./-]", "")), F.lit(3)).cast("int"),
        "plain": hit.rlike(PLAIN[kind]).cast("int"),
        "word": F.when(context.rlike(ANNOUNCED[kind]), ANNOUNCING).when(context.rlike(HARMLESS), NAMING).otherwise(OTHER),
    }
    code = F.lit(0)
    for name, radix in FEATURES:
        code = code * radix + values[name]
    return code.cast("int")


def features_of(cell: int) -> tuple[int, ...]:
    out = []
    for _, radix in reversed(FEATURES):
        cell, x = divmod(cell, radix)
        out.append(x)
    return tuple(reversed(out))


def _found(text: Column, kind: str, pattern: str, row_type: str, row) -> Column:
    """Array of row(start, end, hit, piece before) of the checked matches.
    Pieces and matches go in as one zipped argument, so each expression runs
    once a text."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))

    def step(pos: Column, x: Column) -> tuple[Column, Column, Column]:
        piece, hit = x.getField("p"), x.getField("h")
        s = pos + F.length(piece)
        e = s + F.coalesce(F.length(hit), F.lit(0))
        return e, row(s, e, hit, piece), hit.isNotNull() & F.coalesce(_valid(kind, hit), F.lit(False))

    needs = NEEDS.get(kind)
    some = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return F.when(some, scan(zipped, F.lit(0), row_type, step)["out"]).otherwise(F.expr(f"cast(array() as array<{row_type}>)"))


def base_spans(text: Column, kind: str) -> Column:
    return _found(text, kind, BASE[kind], SPAN, lambda s, e, hit, piece: F.struct(s.alias("s"), e.alias("e")))


def candidates(text: Column) -> Column:
    def row(kind):
        return lambda s, e, hit, piece: F.struct(s.alias("s"), e.alias("e"), _cell(kind, hit, piece).alias("cell"))

    return F.concat(*[_found(text, kind, pattern, CANDIDATE, row(kind)) for kind, pattern in GENERATORS.items()])


def boost(cells: Mapping[tuple[int, ...], tuple[float, float]], rounds: int = ROUNDS, rate: float = RATE):
    """Gradient boosted trees of depth ``DEPTH`` for the log odds of
    (positives, negatives) by feature tuple; returns a scoring function."""
    pos, neg = (sum(c[i] for c in cells.values()) for i in (0, 1))
    start = math.log((pos + 0.5) / (neg + 0.5))
    score = dict.fromkeys(cells, start)
    trees = []

    def best_split(rows: list) -> tuple[int, int] | None:
        found, best = None, 1e-9
        g, h = sum(x[1] for x in rows), sum(x[2] for x in rows)
        for f, (_, radix) in enumerate(FEATURES):
            gl, hl = [0.0] * radix, [0.0] * radix
            for c, cg, ch in rows:
                gl[c[f]] += cg
                hl[c[f]] += ch
            a = b = 0.0
            for cut in range(radix - 1):
                a, b = a + gl[cut], b + hl[cut]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best:
                    found, best = (f, cut), gain
        return found

    def leaf(rows: list) -> float:
        return rate * sum(x[1] for x in rows) / (sum(x[2] for x in rows) + 1)

    def grow(rows: list, depth: int):
        split = best_split(rows) if depth else None
        if split is None:
            return leaf(rows)
        f, cut = split
        return (f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1))

    def value(tree, c) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if c[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        rows = []
        for c, (p, n) in cells.items():
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, score[c]))))
            rows.append((c, p - (p + n) * q, (p + n) * q * (1 - q)))
        tree = grow(rows, DEPTH)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        for c in cells:
            score[c] += value(tree, c)
    return lambda c: start + sum(value(t, c) for t in trees)


def calibrated(points: Iterable[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Isotonic precision by score: (least score, precision) steps, ascending,
    from (score, positives, negatives)."""
    steps: list[list[float]] = []
    for s, p, n in sorted(points):
        if steps and steps[-1][0] == s:
            steps[-1][1] += p
            steps[-1][2] += n
        else:
            steps.append([s, p, n])
        while len(steps) > 1 and steps[-2][1] * (steps[-1][1] + steps[-1][2]) >= steps[-1][1] * (steps[-2][1] + steps[-2][2]):
            last = steps.pop()
            steps[-1][1] += last[1]
            steps[-1][2] += last[2]
    return [(s, p / (p + n)) for s, p, n in steps]


def labelled(counts: Mapping[int, float]) -> dict[int, tuple[float, float]]:
    """(positives, negatives) of each cell from its number of candidates. The
    share ``HIDDEN`` of the values after an announcing or harmless word counts
    once more as if the word were another, labelled by its format alone: the
    trees learn what such values look like, not the words only."""
    formats: dict[int, list[float]] = defaultdict(lambda: [0.0] * CONTEXTS)
    for cell, n in counts.items():
        formats[cell // CONTEXTS][cell % CONTEXTS] += n
    out = {}
    for form, own in formats.items():
        plain = form % 2            # the digit before the word
        share = 0.0 if plain else own[ANNOUNCING] / ((own[ANNOUNCING] + own[NAMING] + UNLABELLED * own[OTHER]) or 1.0)
        weight = {OTHER: own[OTHER] + HIDDEN * (own[ANNOUNCING] + own[NAMING]), ANNOUNCING: own[ANNOUNCING], NAMING: own[NAMING]}
        positive = {OTHER: share, ANNOUNCING: 0.0 if plain else 1.0, NAMING: 0.0}
        for word, n in weight.items():
            if n:
                out[form * CONTEXTS + word] = (positive[word] * n, (1 - positive[word]) * n)
    return out


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> dict[int, float]:
    """Selected cells and their scores, from the candidates of all texts."""
    fold = (F.pmod(F.xxhash64(F.col(text_col)), F.lit(FOLDS)) == 0).alias("held")
    rows = docs.select(fold, F.explode(candidates(F.col(text_col))).alias("c"))
    table = rows.groupBy("c.cell", "held").agg(F.count(F.lit(1)).alias("n")).collect()      # at most 2 * CELLS rows
    learn, test = (labelled({r["cell"]: float(r["n"]) for r in table if r["held"] == held}) for held in (False, True))
    if not any(p for p, _ in learn.values()) or not any(p for p, _ in test.values()):
        return {}
    score = boost({features_of(c): x for c, x in learn.items()})
    steps = calibrated((score(features_of(c)), p, n) for c, (p, n) in test.items())
    enough = [s for s, share in steps if share >= precision]
    if not enough:
        return {}
    scores = {c: score(features_of(c)) for c in {*learn, *test}}
    return {c: s for c, s in scores.items() if s >= min(enough)}


def with_spans(docs: DataFrame, text_col: str, selected: Mapping[int, float], name: str = "__pii") -> DataFrame:
    """``docs`` with a struct column ``name``: an array of spans for each kind."""
    text = F.col(text_col)
    base = [base_spans(text, kind).alias(kind) for kind in BASE]
    chosen = sorted(selected)
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    if not chosen:
        return docs.withColumn(name, F.struct(*base, *[empty.alias(k) for k in GENERATORS]))
    scores = F.create_map(*[F.lit(x) for c in chosen for x in (c, float(selected[c]))])
    both = F.struct(*base, F.filter(candidates(text), lambda c: F.map_contains_key(scores, c["cell"])).alias("cand"))
    place = "struct<s:int,e:int,cell:int>"

    def merged(z: Column) -> Column:
        """Base spans (cell -1) and candidates in text order."""
        known = F.transform(F.concat(*[z[k] for k in BASE]), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.lit(-1).alias("cell")))
        return F.sort_array(F.concat(known, z["cand"]))

    def after_base(reached: Column, x: Column) -> tuple[Column, Column, Column]:
        """Drops candidates that begin before the end of a base span."""
        own = x["cell"] < 0
        return F.when(own, F.greatest(reached, x["e"])).otherwise(reached), x, own | (x["s"] >= reached)

    def before_base(least: Column, x: Column) -> tuple[Column, Column, Column]:
        """In falling order: drops candidates that end after the start of one, and base spans."""
        own = x["cell"] < 0
        return F.when(own, F.least(least, x["s"])).otherwise(least), x, ~own & (x["e"] <= least)

    def better(kept: Column, x: Column) -> tuple[Column, Column, Column]:
        """Holds the last span; a touching one of a higher score replaces it."""
        apart = kept["cell"].isNull() | (x["s"] >= kept["e"])
        wins = apart | (F.element_at(scores, x["cell"]) > F.element_at(scores, kept["cell"]))
        return F.when(wins, x).otherwise(kept), kept, apart & kept["cell"].isNotNull()

    def resolved(z: Column) -> Column:
        clear = scan(merged(z), F.lit(0), place, after_base)["out"]
        clear = F.reverse(scan(F.reverse(clear), F.lit(2**31 - 1), place, before_base)["out"])
        held = scan(clear, F.expr(f"cast(null as {place})"), place, better)
        return once(held, lambda r: F.when(r["state"]["cell"].isNull(), r["out"]).otherwise(F.array_append(r["out"], r["state"])))

    def resolve(z: Column) -> Column:
        kept = F.when(F.size(z["cand"]) > 0, resolved(z)).otherwise(F.expr(f"cast(array() as array<{place}>)"))
        return F.struct(*[z[k].alias(k) for k in BASE], kept.alias("kept"))

    def by_kind(z: Column) -> Column:
        def own(i: int) -> Column:
            mine = F.filter(z["kept"], lambda c: F.floor(c["cell"] / (CELLS // FEATURES[0][1])) == i)
            return F.transform(mine, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e")))
        return F.struct(*[z[k].alias(k) for k in BASE], *[own(i).alias(k) for i, k in enumerate(GENERATORS)])

    return docs.withColumn(name, once(once(both, resolve), by_kind))


def _listed(spans: Column, kinds: Iterable[str]) -> Column:
    def said(kind: str) -> Column:
        return F.transform(spans[kind], lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))

    return F.array_join(F.concat(*[said(k) for k in kinds]), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every
    row; ``n_`` counts are of the base kinds."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = with_spans(own, "text", fit(own)).select("doc_id", F.col("__pii").alias("x"))
    return found.select("doc_id", *[F.size(F.col("x")[k]).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(_listed(F.col("x"), BASE), 256).alias("base_sha256"),
                        _listed(F.col("x"), [*BASE, *GENERATORS]).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind, as in
    [EMAIL]; touching spans give one mark, that of the first. A null text stays
    null; ``n_chars``, where it is a column, follows the new text."""
    plain = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = with_spans(docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))), "__text", fit(plain))

    def marks(kind: str) -> Column:
        return F.transform(F.col("__pii")[kind], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("mark")))

    every = F.sort_array(F.concat(*[marks(k) for k in (*BASE, *GENERATORS)]))
    text = F.col("__text")
    place = "struct<s:int,e:int,mark:string>"
    apart = scan(every, F.lit(0), place, lambda pos, x: (F.greatest(pos, x["e"]), x, x["s"] >= pos))["out"]

    def rewritten(spans: Column) -> Column:
        """A part of the text for each ``CHUNK`` spans, so that no search for a place runs over the whole text."""
        def part(c: Column) -> Column:
            start = F.coalesce(F.get(spans, c * CHUNK - 1)["e"], F.lit(0))
            own = F.slice(spans, c * CHUNK + 1, F.lit(CHUNK))

            def marked(z: Column) -> Column:
                def piece(x: Column, i: Column) -> Column:
                    last = F.coalesce(F.get(z["own"], i - 1)["e"], z["start"])
                    return F.concat(F.substr(z["text"], last - z["start"] + 1, x["s"] - last), x["mark"])
                return F.array_join(F.transform(z["own"], piece), "")

            def cut(o: Column) -> Column:
                return F.struct(o.alias("own"), start.alias("start"), F.substr(text, start + 1, F.element_at(o, -1)["e"] - start).alias("text"))

            return once(once(own, cut), marked)

        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), part)
        return F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(spans, -1)["e"] + 1))

    done = once(apart, lambda spans: F.when(F.size(spans) > 0, rewritten(spans)).otherwise(text))
    clean = F.when(F.col(text_col).isNotNull(), done)
    out = marked.withColumn(text_col, clean).drop("__pii", "__text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

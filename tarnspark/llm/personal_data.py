"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns find base spans, which always count. Looser patterns (spelled-out addresses, numbers without a country code,
colon addresses, other groupings) and the base spans together are candidates. Five labelers vote on each: its form, its
structure or checksum, a gazetteer, words before it that speak for it, and words that speak against it. All votes of all
documents are counted by pattern, a table of bounded size; expectation-maximisation over it estimates how reliable each
labeler is for each kind, and a logistic regression on votes and shape is fitted to the labels that follow. Candidates that
it accepts, apart from base spans, are added. Texts are read twice, nothing but the pattern counts is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.columns import fresh, without

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats and the look behind keep the time linear in the text and do not change what is found.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[(\[{](?i:at)[)\]}]\x20?|\x20(?i:at)\x20)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[(\[{](?i:dot)[)\]}]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{12,19}+|[0-9]{4}(?:[\x20._/-][0-9]{4}){2}[\x20._/-][0-9]{1,7}+)(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,4}\)?(?:[\x20./-]\(?[0-9]{2,4}\)?){1,4}+(?![0-9A-Za-z]|[.-][0-9])",
}
#: What a text must hold for a pattern to be worth a search.
DIGIT, AT = "[0-9]", r"@|[\x20(\[{][Aa][Tt][\x20)\]}]"

# Common top-level domains, country calling codes and card issuer prefixes.
DOMAINS = "com org net edu gov mil int info biz io dev app name de fr es it uk nl be ch at eu us ca au nz jp cn in br ru se no dk fi pl pt ie".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 356 357 358 359 370 371 372 380 385 386 420 421".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
SPEAKS_FOR = {
    "email": "mail|contact|write|reply|kontakt|correo|courriel|adress", "ip": r"\bip\b|host|server|address|login|adress",
    "card": "card|visa|credit|karte|carte|tarjeta|payment", "phone": "tel|phone|call|fax|mobile|whatsapp|rufnummer|móvil",
}
SPEAKS_AGAINST = {
    "email": "look|stay|arrive|meet|begin|start", "ip": "version|release|time|section|chapter|clock|uhr", "card": "isbn|order|invoice|serial|token|hash|number of",
    "phone": "isbn|order|invoice|page|version|price|year|section|total|score",
}
#: Places of a pattern (five votes, then length, digits and spaces by class), values of each, and code points before a span that are looked at.
VOTES, PLACES, LEVELS, BEFORE = 5, 8, 4, 32
ROUNDS, STEPS, RATE, SHRINK = 20, 30, 0.5, 1.0
#: Counts that stand for what is believed of a labeler beforehand: of its votes no, yes, none on true and on false candidates.
BELIEF = {True: (2.0, 8.0, 5.0), False: (8.0, 2.0, 5.0)}
#: Sums run within so many elements and then over such stretches, so that time stays nearly linear in an array.
RUN = 128

# The expressions below are SQL text, which is built in one call each; {hit} and the like are filled in.
_LOCATED = """
CASE WHEN size({hits}) > 0 THEN get(transform(array(
  get(transform(array(transform({hits}, (h, i) -> CAST(length(get({gaps}, i)) + length(h) AS BIGINT))), steps -> flatten(aggregate(
    transform(sequence(0, CAST((size(steps) - 1) div {run} AS INT)), b -> aggregate(
      slice(steps, b * {run} + 1, {run}), named_struct('total', 0L, 'sums', CAST(array() AS ARRAY<BIGINT>)),
      (s, x) -> named_struct('total', s.total + x, 'sums', array_append(s.sums, s.total)))),
    named_struct('total', 0L, 'sums', CAST(array() AS ARRAY<ARRAY<BIGINT>>)),
    (s, p) -> named_struct('total', s.total + p.total, 'sums', array_append(s.sums, transform(p.sums, x -> x + s.total)))).sums)), 0)
), base -> transform({hits}, (h, i) -> named_struct(
  'start', get(base, i) + length(get({gaps}, i)), 'end', get(base, i) + length(get({gaps}, i)) + length(h),
  'hit', h, 'digits', regexp_replace(h, '[^0-9]+', ''), 'before', lower(right(get({gaps}, i), {before}))
))), 0) END
"""
_LUHN = """(length({d}) BETWEEN 12 AND 19 AND aggregate(
  CASE WHEN length({d}) BETWEEN 12 AND 19 THEN transform(sequence(1, length({d})), i -> CAST(substr(reverse({d}), i, 1) AS INT) * (2 - i % 2)) END,
  0, (s, x) -> s + CASE WHEN x > 9 THEN x - 9 ELSE x END) % 10 = 0)"""
_SMALL = r"""forall(split({h}, r'\.'), x -> length(regexp_replace(x, '^0++', '')) < 3 OR (length(regexp_replace(x, '^0++', '')) = 3 AND regexp_replace(x, '^0++', '') <= '255'))"""


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _either(test: str) -> str:
    return f"CASE WHEN {test} THEN '1' ELSE '0' END"


H, D = "c.hit", "c.digits"
LUHN, SMALL = _LUHN.format(d=D), _SMALL.format(h=H)
#: What a strict hit must fulfil besides its pattern.
HOLDS = {"email": "true", "ip": SMALL, "card": LUHN, "phone": f"length({D}) BETWEEN 9 AND 15"}
#: Of the looser hits only those that the strict pattern would cut otherwise.
WIDER = {"email": rf"{H} rlike r'[\x20(\[{{]'"}
FORM = {
    "email": rf"CASE WHEN {H} rlike r'[(\[{{]' THEN '2' ELSE {_either(f'NOT contains({H}, " ")')} END",
    "ip": _either(rf"contains({H}, '::') OR {H} rlike r'^[0-9]++(?:\.[0-9]++){{3}}$|^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$'"),
    "card": _either(rf"{H} rlike r'^[0-9]{{12,19}}$|^[0-9]{{4}}([\x20._/-])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}$' AND {LUHN}"),
    "phone": _either(rf"{H} rlike r'^\+|^\(?[2-9][0-9]{{2}}\)?[\x20.-][0-9]{{3}}[.-][0-9]{{4}}$|^0[0-9]{{2,3}}[\x20/-]'"),
}
STRUCTURE = {
    "email": _either(rf"{H} rlike r'^[A-Za-z0-9][^@\x20(\[{{]*+(?:@|\x20?[(\[{{]|\x20(?i:at)\x20)'"),
    "ip": f"CASE WHEN contains({H}, '.') THEN {_either(SMALL)} ELSE {_either(f'{H} rlike "[A-Fa-f]|::"')} END",
    "card": _either(LUHN),
    "phone": f"CASE WHEN length({D}) BETWEEN 9 AND 15 THEN '1' WHEN length({D}) BETWEEN 7 AND 8 THEN '2' ELSE '0' END",
}
GAZETTEER = {
    "email": _either(f"lower(regexp_extract({H}, '[A-Za-z0-9-]++$', 0)) IN {_in(DOMAINS)}"),
    "ip": rf"CASE WHEN contains({H}, '.') THEN {_either(rf"{H} rlike r'^0*+[0-9]{{1,3}}\.' AND NOT {H} rlike r'^0*+(?:127|22[4-9]|2[3-9][0-9])?\.'")}"
    rf" ELSE {_either(f"{H} rlike '^(?:2[0-9a-fA-F]{{3}}|[fF][cdeCDE][0-9a-fA-F]{{2}}):'")} END",
    "card": _either(f"{D} rlike '{ISSUERS}'"),
    "phone": rf"CASE WHEN startswith({H}, '+') THEN {_either(' OR '.join(f'substr({D}, 1, {n}) IN {_in(CALLING)}' for n in (1, 2, 3)))} WHEN {H} rlike r'^\(|^0' THEN '1' ELSE '2' END",
}


def pattern(kind: str) -> str:
    """A candidate's votes and shape, a digit each, as SQL over a struct ``c`` of hit, digits and before."""
    return f"""concat({FORM[kind]}, {STRUCTURE[kind]}, {GAZETTEER[kind]},
      CASE WHEN c.before rlike r'{SPEAKS_FOR[kind]}' THEN '1' ELSE '2' END, CASE WHEN c.before rlike r'{SPEAKS_AGAINST[kind]}' THEN '0' ELSE '2' END,
      CASE WHEN length({H}) < 10 THEN '0' WHEN length({H}) < 16 THEN '1' WHEN length({H}) < 32 THEN '2' ELSE '3' END,
      CAST(length({D}) * 3 div length({H}) AS STRING), CAST(least(length({H}) - length(replace({H}, ' ', '')), 3) AS STRING))"""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_FOUND = "array<struct<start:bigint,kind:int,end:bigint,key:string,base:boolean>>"


def _searched(rows: DataFrame, body: Column, names: dict[str, str]) -> DataFrame:
    """Add, under the given names, base spans and the other candidates that meet none of them.

    Strict hits whose numbers do not hold are among the latter: they show what is no personal data.
    """
    keep = [F.col(f"`{c}`") for c in rows.columns]
    has = {"email": body.contains("@"), "ip": body.rlike(DIGIT), "card": body.rlike(DIGIT), "phone": body.contains("+")}
    may = {"email": body.rlike(AT), **dict.fromkeys(("ip", "card", "phone"), body.rlike(DIGIT))}
    found = []
    for when, patterns, which in ((has, BASE_PATTERNS, "base"), (may, LOOSE_PATTERNS, "loose")):
        for kind in KINDS:
            found.append(F.when(when[kind], F.split(body, patterns[kind], -1)).alias(names[f"{which}_{kind}_gaps"]))
            found.append(F.when(when[kind], F.regexp_extract_all(body, F.lit(patterns[kind]), F.lit(0))).alias(names[f"{which}_{kind}_hits"]))
    cut = rows.select(*keep, *found)
    placed = [names[f"{which}_{kind}"] for which in ("base", "loose") for kind in KINDS]
    located = cut.select(*keep, *[F.expr(_LOCATED.format(hits=f"`{n}_hits`", gaps=f"`{n}_gaps`", run=RUN, before=BEFORE)).alias(n) for n in placed])

    def listed(which: str, base: bool) -> Column:
        wanted = {k: ("" if base else "NOT ") + f"({HOLDS[k]})" if which == "base" else WIDER.get(k, "true") for k in KINDS}
        parts = [
            f"""coalesce(transform(filter(`{names[f"{which}_{k}"]}`, c -> {wanted[k]}), c -> named_struct('start', c.start, 'kind', {n}, 'end', c.end,
            'key', concat('{k[0]}{int(base)}', {pattern(k)}), 'base', {str(base).lower()})), CAST(array() AS {_FOUND}))"""
            for n, k in enumerate(KINDS)
        ]
        return F.expr(f"concat({', '.join(parts)})")

    split = located.select(*keep, listed("base", True).alias(names["base"]), F.array_distinct(F.concat(listed("base", False), listed("loose", False))).alias(names["loose"]))
    apart = F.filter(F.col(names["loose"]), lambda c: ~F.exists(F.col(names["base"]), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return split.select(*keep, F.col(names["base"]), apart.alias(names["loose"]))


def _names(df: DataFrame) -> dict[str, str]:
    (own,) = fresh(df, "spans_")
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    return {w: f"{own}{w}" for w in ("base", "loose", *(f"{a}_{k}{b}" for a in ("base", "loose") for k in KINDS for b in ("", "_gaps", "_hits")))}


def _sum(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.transform(values, of), F.lit(0.0), lambda s, x: s + x)


def reliabilities(rows: Column) -> Column:
    """Labels of the patterns (array of struct<v: array<int>, n: double, base: boolean>): how sure each is, 1 for base spans.

    Each round estimates the share of true candidates and how each labeler votes on true and on false ones, and labels anew.
    The first labels are the shares of yes votes.
    """
    ones = lambda r, vote: F.size(F.filter(F.slice(r["v"], 1, VOTES), lambda v: v == vote))
    known = lambda r, label: F.when(r["base"], F.lit(1.0)).otherwise(label)
    first = F.transform(rows, lambda r: known(r, (ones(r, 1) + 0.5) / (ones(r, 0) + ones(r, 1) + 1.0)))

    def table(label: Column, true: bool) -> Column:
        weight = lambda r, i: r["n"] * (F.get(label, i) if true else 1 - F.get(label, i))
        held = lambda c: _sum(rows, lambda r, i: F.when(F.get(r["v"], F.floor(c / 3).cast("int")) == c % 3, weight(r, i)).otherwise(0.0))
        belief = F.array(*[F.lit(b) for b in BELIEF[true]])
        return let(_sum(rows, weight), lambda all_: F.concat(F.array(F.log(all_ + 1.0)), F.transform(F.sequence(F.lit(0), F.lit(3 * VOTES - 1)), lambda c: F.log((held(c) + F.get(belief, c % 3)) / (all_ + sum(BELIEF[True]))))))

    def again(label: Column, _: Column) -> Column:
        def judged(t: Column) -> Column:
            odds = lambda r: F.aggregate(
                F.sequence(F.lit(0), F.lit(VOTES - 1)), F.get(t["yes"], F.lit(0)) - F.get(t["no"], F.lit(0)),
                lambda s, k: let(1 + 3 * k + F.get(r["v"], k), lambda at: s + F.get(t["yes"], at) - F.get(t["no"], at)),
            )
            return F.transform(rows, lambda r: known(r, 1 / (1 + F.exp(-odds(r)))))

        return let(F.struct(table(label, True).alias("yes"), table(label, False).alias("no")), judged)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, again)


def span_scores(rows: Column) -> Column:
    """Scores of the patterns (array of struct<v, n, y>) by logistic regression on the values of all places, fitted to y."""
    size = PLACES * LEVELS
    add = lambda r, w: F.aggregate(F.sequence(F.lit(0), F.lit(PLACES - 1)), F.lit(0.0), lambda s, k: s + F.get(w, k * LEVELS + F.get(r["v"], k)))
    score = lambda r, w: 1 / (1 + F.exp(-add(r, w)))
    mine = lambda r, j: F.get(r["v"], F.floor(j / LEVELS).cast("int")) == j % LEVELS
    every = F.sequence(F.lit(0), F.lit(size - 1))

    def step(w: Column, _: Column) -> Column:
        def moved(off: Column) -> Column:
            pull = lambda j: _sum(rows, lambda r, i: F.when(mine(r, j), F.get(off, i)).otherwise(0.0)) - SHRINK * F.get(w, j)
            held = lambda j: _sum(rows, lambda r, i: F.when(mine(r, j), r["n"]).otherwise(0.0)) + SHRINK
            return F.transform(every, lambda j: F.get(w, j) + RATE * pull(j) / held(j))

        return let(F.transform(rows, lambda r: r["n"] * (r["y"] - score(r, w))), moved)

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array_repeat(F.lit(0.0), size), step)
    return let(fitted, lambda w: F.transform(rows, lambda r: score(r, w)))


def fitted_scores(keys: DataFrame) -> DataFrame:
    """One row: a map from every occurring key (kind and pattern) to its score, from a table of keys.

    There are at most 4 x 2 x 3^5 x 4^3 keys, so this is of bounded size whatever the corpus.
    """
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    values = F.transform(F.sequence(F.lit(3), F.lit(2 + PLACES)), lambda i: F.substr(F.col("key"), i, F.lit(1)).cast("int"))
    listed = counted.groupBy(F.substr("key", F.lit(1), F.lit(1)).alias("kind")).agg(F.array_sort(F.collect_list(F.struct("key", values.alias("v"), "n", (F.substr("key", F.lit(2), F.lit(1)) == "1").alias("base")))).alias("rows"))
    believed = listed.select("rows", reliabilities(F.col("rows")).alias("y"))
    labelled = believed.select(F.transform("rows", lambda r, i: F.struct(r["key"].alias("key"), r["v"].alias("v"), r["n"].alias("n"), F.get("y", i).alias("y"))).alias("rows"))
    scored = labelled.select("rows", span_scores(F.col("rows")).alias("score"))
    entries = F.transform("rows", lambda r, i: F.struct(r["key"], F.get("score", i)))
    return scored.agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("scores"))


def find_personal_data(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Add spans: array of (start, kind, end, score, base) by start and kind; a column named spans is replaced, others stay.

    Places are code points, ends exclusive. Base spans are those of the strict patterns whose numbers hold (parts of an
    address, check digit, count of digits), leftmost and not overlapping within a kind; a failing one is dropped and not tried
    again. Other candidates are added from a score of ``least`` on where they meet no base span. Scores of all spans come from
    the classifier that is fitted to these documents. Null or empty texts have no spans; repeated rows are rows of their own
    and count as often; an empty table stays empty. Spans of different kinds may overlap.
    """
    docs = without(docs, "spans")
    bare = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    names = _names(bare)
    both = _searched(bare, F.col("body"), names)
    keys = both.select(F.explode(F.concat(F.col(names["base"]), F.col(names["loose"]))).alias("c")).select(F.col("c.key").alias("key"))
    names = _names(docs)
    searched = _searched(docs, F.coalesce(F.col(f"`{text}`"), F.lit("")), names)
    (read,) = fresh(searched, "scores")
    told = searched.crossJoin(F.broadcast(fitted_scores(keys).withColumnRenamed("scores", read)))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    every = f"""array_sort(filter(transform(concat(`{names["base"]}`, `{names["loose"]}`),
      c -> named_struct('start', c.start, 'at', c.kind, 'end', c.end, 'score', coalesce(try_element_at(`{read}`, c.key), 0D), 'base', c.base)), s -> s.base OR s.score >= {float(least)}))"""
    spans = f"transform({every}, s -> named_struct('start', s.start, 'kind', get({kinds}, s.at), 'end', s.end, 'score', s.score, 'base', s.base))"
    return told.select(*[F.col(f"`{c}`") for c in docs.columns], F.expr(spans).alias("spans"))

"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns find the seeds: e-mail addresses, IP addresses, payment cards and phone numbers. These spans, and
all further identifier-like tokens (those with a digit or an at sign, whole phone numbers, and groups of digits),
are then listed with the lexical patterns around them: the two words before, and the word before with the word after. In each round, a
pattern's confidence for a kind is the share of its distinct instances that are known to be of that kind,
and an instance's score is the chance that not all its patterns err; patterns above ``CONFIDENCE`` with
enough known instances vote, and instances above ``SCORE`` are known in the next round. Instances that are
known at last and are no seeds give further spans, which never replace or overlap seed spans.

Positions need no search: the lengths of the parts between matches and of the matches add up to them. The
patterns use possessive runs and word starts, so that their time is linear in the text.

Defined results: null counts as empty; equal rows get equal results, null ids too; a match that fails its
check is dropped without another try; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.draws import bind
from lexiloom.llm.common import stored, text_or_empty

#: The seed patterns, in the order in which spans are listed. They match what the plain
#: patterns match, written so that no run of characters is tried from each of its positions.
LOCAL = r"[A-Za-z0-9._%+-]"
SEEDS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text must hold to be searched for a kind.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = r"(?:0++|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"
WHITE = r"\x20\x09-\x0D"
#: A whole phone number, up to eight groups of digits, or a token with a digit or an at sign.
TOKEN = (
    rf"\+[0-9][\x20().0-9-]+[0-9]|(?<![^{WHITE}])[0-9]++(?:[\x20-][0-9]++){{1,7}}+(?![^{WHITE}])"
    rf"|(?<![^{WHITE}])[^{WHITE}0-9@]*+[0-9@][^{WHITE}]*+"
)
#: Signs at either end that belong to no identifier; a run at the end is tried from its start only.
EDGES = r"^[^A-Za-z0-9+(]++|(?<=[A-Za-z0-9)])[^A-Za-z0-9)]++$"
#: Characters of the text beside a token that its patterns are looked for in.
NEAR = 120
CONFIDENCE = 0.8
SCORE = 0.9
#: Least distinct known instances of a pattern that votes, and least length of a found identifier.
SUPPORT = 5
SHORTEST = 5
ROUNDS = 3
#: Matches whose positions are gathered in one array before it is added to the others of the text.
RUN = 512
SPAN = "array<struct<kind:string,start:int,end:int>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass the check sum: every second one from the right counts double."""
    number = F.reverse(digits(match))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(number, place, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


CHECKS = {
    "email": lambda match: F.lit(True),
    "ip": lambda match: match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda match: F.length(digits(match)).between(16, 19) & luhn(match),
    "phone": lambda match: F.length(digits(match)).between(8, 15),
}


def located(df: DataFrame, text: str, patterns: dict[str, str], near: bool = False) -> DataFrame:
    """``df`` with an array ``_<name>`` per pattern: all matches, leftmost and not overlapping.

    An element has start, end and match, and with ``near`` also the text between it and the matches beside it.
    The matches and the parts between them are columns first, so that each pattern runs twice per text.
    """
    out = df
    for name, pattern in patterns.items():
        sought = F.lit(True) if NEEDED.get(name) is None else F.col(text).contains(NEEDED[name])
        sought = sought & F.col(text).rlike("[0-9@]" if name == "token" else "[0-9]") if name != "email" else sought
        none = F.array().cast("array<string>")
        out = out.withColumns(
            {
                f"_{name}_match": F.when(sought, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
                f"_{name}_part": F.when(sought, F.split(text, pattern, -1)).otherwise(none),
            }
        )
    return _placed(out, patterns, near)


def _run_start(seen: Column) -> Column:
    return F.struct(seen["at"].alias("at"), F.array().cast("array<int>").alias("starts"))


def _next_start(seen: Column, step: Column) -> Column:
    return F.struct(
        (seen["at"] + step["skip"] + step["size"]).alias("at"),
        F.array_append(seen["starts"], seen["at"] + step["skip"]).alias("starts"),
    )


def _run_added(seen: Column, run: Column) -> Column:
    return bind(run, lambda r: F.struct(r["at"].alias("at"), F.concat(seen["starts"], r["starts"]).alias("starts")))


def _placed(df: DataFrame, names, near: bool) -> DataFrame:
    """Positions from the lengths of the matches and of the parts between them."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    columns = {}
    for name in names:
        match, part = F.col(f"_{name}_match"), F.col(f"_{name}_part")
        sizes = F.zip_with(
            F.slice(part, F.lit(1), F.size(match)),
            match,
            lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m).alias("size")),
        )
        starts = F.aggregate(
            F.sequence(F.lit(0), F.expr(f"cast((size(_{name}_match) - 1) div {RUN} as int)")),
            begin,
            lambda seen, run: _run_added(seen, F.aggregate(F.slice(sizes, run * RUN + 1, F.lit(RUN)), _run_start(seen), _next_start)),
            lambda seen: seen["starts"],
        )
        zipped = [starts.alias("start"), match.alias("match")]
        if near:
            size = F.size(match)
            zipped += [F.slice(part, F.lit(1), size).alias("before"), F.slice(part, F.lit(2), size).alias("after")]
        columns[f"_{name}"] = F.transform(
            F.arrays_zip(*zipped),
            lambda x: F.struct(
                x["start"].alias("start"),
                (x["start"] + F.length(x["match"])).alias("end"),
                x["match"].alias("match"),
                *([x["before"].alias("before"), x["after"].alias("after")] if near else []),
            ),
        )
    return df.withColumns(columns).drop(*[f"_{n}_{end}" for n in names for end in ("match", "part")])


def _checked(kind: str) -> Column:
    """The spans of the matches of a kind that pass its check."""
    found = F.filter(f"_{kind}", lambda x: CHECKS[kind](x["match"]))
    return F.transform(
        found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    )


def seed_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, base): the checked seed spans of each text, by kind as listed and then by start."""
    base = F.concat(*[_checked(kind) for kind in SEEDS])
    return located(texts, "text", SEEDS).select("doc_id", "mark", base.cast(SPAN).alias("base"))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _bare(word: Column) -> Column:
    """A word without what is no letter; empty at the edge of a text."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}]+", ""))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns around a place: the two words before, and the words before and after."""
    before, after = F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))
    last, last_but_one = rf"([^{WHITE}]+)[{WHITE}]*$", rf"([^{WHITE}]+)[{WHITE}]+[^{WHITE}]+[{WHITE}]*$"
    near = _bare(F.regexp_extract(before, last, 1))
    far = _bare(F.regexp_extract(before, last_but_one, 1))
    follows = _bare(F.regexp_extract(after, rf"^[{WHITE}]*([^{WHITE}]+)", 1))
    patterns = F.array(
        F.when((near != "") & (far != ""), F.concat_ws(" ", far, near, F.lit("*"))),
        F.when((near != "") & (follows != ""), F.concat_ws(" ", near, F.lit("*"), follows)),
    )
    return F.filter(patterns, lambda p: p.isNotNull())


def _seen(kind: str) -> Column:
    """The matches of a kind that pass its check, with the text beside them."""
    found = F.filter(f"_{kind}", lambda x: CHECKS[kind](x["match"]))
    fields = ("start", "end", "match", "before", "after")
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in fields]))


def seed_occurrences(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, start, end, value, kind, patterns) of every checked seed span of (doc_id, mark, text)."""
    each = F.concat(*[_seen(kind) for kind in SEEDS])
    spans = located(texts, "text", SEEDS, near=True).select("doc_id", "mark", F.explode(each).alias("s"))
    return spans.select(
        "doc_id", "mark", "s.start", "s.end", F.col("s.match").alias("value"), "s.kind",
        _patterns(F.col("s.before"), F.col("s.after")).alias("patterns"),
    )


def occurrences(texts: DataFrame) -> DataFrame:
    """(doc_id, mark, start, end, value, kind, patterns): the seed spans, and every identifier-like token.

    ``kind`` is null where a token is no seed.
    """
    held = texts.where(F.col("text").rlike("[0-9@]"))
    tokens = located(held, "text", {"token": TOKEN}, near=True).select("doc_id", "mark", F.explode("_token").alias("t"))
    lead = F.length(F.regexp_extract("t.match", r"^[^A-Za-z0-9+(]+", 0))
    value = F.regexp_replace("t.match", EDGES, "")
    listed = tokens.select(
        "doc_id",
        "mark",
        (F.col("t.start") + lead).alias("start"),
        value.alias("value"),
        _patterns(F.col("t.before"), F.col("t.after")).alias("patterns"),
    ).where(F.length("value") >= SHORTEST)
    kind = F.coalesce(
        *[
            F.when(F.col("value").rlike(f"^(?:{pattern})$") & CHECKS[kind](F.col("value")), F.lit(kind))
            for kind, pattern in SEEDS.items()
        ]
    )
    end = F.col("start") + F.length("value")
    listed = listed.select("doc_id", "mark", "start", end.alias("end"), "value", kind.alias("kind"), "patterns")
    return seed_occurrences(held).unionByName(listed.where("kind is null"))


def bootstrap(found: DataFrame) -> DataFrame:
    """(value, kind) of the instances that patterns learned from the seeds make known."""
    edges = stored(
        found.select("value", "kind", F.explode("patterns").alias("pattern")).distinct(), "pattern-graph"
    )
    totals = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n"))
    totals = stored(totals.where(F.col("n") >= SUPPORT), "pattern-totals")
    seeds = edges.where("kind is not null").select("value", "kind").distinct()
    open_edges = edges.where("kind is null").select("value", "pattern")
    learned = None
    for _ in range(ROUNDS):
        known = seeds if learned is None else seeds.unionByName(learned)
        support = edges.select("pattern", "value").distinct().join(known, "value")
        voting = (
            support.groupBy("pattern", "kind")
            .agg(F.count("*").alias("positive"))
            .where(F.col("positive") >= SUPPORT)
            .join(totals, "pattern")
            .select("pattern", "kind", (F.col("positive") / F.col("n")).alias("confidence"))
            .where(F.col("confidence") >= CONFIDENCE)
        )
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        scored = (
            open_edges.join(voting, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(doubt)).alias("score"))
            .where(F.col("score") >= SCORE)
            .groupBy("value")
            .agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        )
        learned = stored(scored, "learned")
    return learned


def spans_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Column]:
    """(doc_id, mark, base, added) for each row, and the mark of a text: spans of seeds and of learned patterns.

    ``mark`` is a checksum of the text; with the id, it tells rows apart without moving texts.
    """
    text = text_or_empty(text_col)
    mark = F.xxhash64(text)
    texts = df.select(F.col(id_col).alias("doc_id"), mark.alias("mark"), text.alias("text"))
    seeds = seed_spans(texts)
    found = stored(occurrences(texts), "occurrences")
    learned = bootstrap(found)
    span = F.struct("kind", "start", "end")
    further = (
        found.where("kind is null")
        .drop("kind")
        .join(learned, "value")
        .groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        .agg(F.array_sort(F.collect_set(span)).alias("further"))
    )
    both = seeds.join(further, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    clear = F.filter(
        F.coalesce("further", F.array().cast(SPAN)),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return both.select("doc_id", "mark", "base", clear.alias("added")), mark


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def in_order(spans: Column) -> Column:
    """Spans by kind as listed and then by start."""
    return F.concat(*[_of_kind(F.array_sort(spans), kind) for kind in SEEDS])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row; counts are of seed spans."""
    spans, _ = spans_of(df, id_col, text_col)
    counts = [F.size(_of_kind(F.col("base"), kind)).cast("bigint").alias(f"n_{kind}") for kind in SEEDS]
    return spans.select(
        F.col("doc_id").alias(id_col),
        *counts,
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(in_order(F.concat("base", "added"))).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or each group of overlapping spans, replaced by its (first) kind in brackets."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        by_start,
        begin,
        lambda seen, s: F.when(
            s["start"] >= seen["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    seen["out"],
                    F.substring(text, seen["at"] + 1, s["start"] - seen["at"]),
                    F.lit("["),
                    F.upper(s["kind"]),
                    F.lit("]"),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(seen["at"], s["end"]).alias("at"), seen["out"].alias("out"))),
        lambda seen: F.concat(seen["out"], F.substring(text, seen["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with personal data masked in ``text_col``; null texts stay null, other columns as they are."""
    spans, mark = spans_of(df, id_col, text_col)
    some = spans.where(F.size("base") + F.size("added") > 0).select(
        F.col("doc_id").alias("_pii_id"), F.col("mark").alias("_pii_mark"), F.concat("base", "added").alias("_pii_spans")
    )
    some = some.distinct()
    here = F.col(id_col).eqNullSafe(F.col("_pii_id")) & (mark == F.col("_pii_mark"))
    text = F.when(F.col("_pii_spans").isNull(), F.col(text_col)).otherwise(
        masked(F.col(text_col).cast("string"), F.col("_pii_spans"))
    )
    return df.join(some, here, "left").withColumn(text_col, text).drop("_pii_id", "_pii_mark", "_pii_spans")

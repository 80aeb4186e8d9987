"""Personal data in texts: exact base patterns, and further spans chosen by boosted trees.

Base spans are the leftmost non-overlapping matches of one pattern per kind that pass
the kind's check. Generators with looser patterns then propose further spans, which
may overlap. Each proposal has a few whole-numbered features of its format and its
surroundings, from which boosted trees tell personal data.

What is to be added is, by definition, no base span, so base spans alone cannot teach
it. Each shape of one becomes several copies in its surroundings: written as people write
such data past a filter (``(at)``, ``[dot]``, a missing plus, other separators), and damaged
or replaced by what only looks alike (a wrong check digit, a part over 255, a date, a
social-security number, a plain word ``at`` a host). The former are positive. Negative are
the latter, proposals in the texts that fail the check, and, as the hard ones, every plain
word ``at`` a host, without a cue, in a text that has no base email. (Texts without base spans teach nothing
of other ways of writing: what is hidden in them on purpose is what is looked for.) Trees learn
on all documents but a held-out fifth, whose copies and proposals give, for each way of writing each kind, the score from which
on the precision wanted is reached with a margin of error; a way of writing without
enough of them adds nothing.

Only DataFrame functions touch rows, and nothing is shuffled but counts of distinct shapes
and feature vectors: all spans of a text live in one array beside it. The patterns are
written so that matching takes time in proportion to the text: repeats give nothing
back, and a run of characters is entered only at its start.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import boost, calibrated_cut
from .shared import materialize

#: Kinds in the order that sorts spans with equal starts.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole runs of 12 to 19 digits: shorter and longer ones fail the check anyway.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:@|\(at\)|\[at\]) ?| at )[A-Za-z0-9-]++"
    r"(?:(?: ?(?:\.|\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)| \. )[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[ ./()-]{1,3}+[0-9]{2,4}+){2,4}+(?![0-9])",
}
#: Words before a span that speak for its kind, and one of them.
CUES = {
    "email": (r"(?i)(mail|contact|write)\W*$", "mail"),
    "ip": (r"(?i)(ip|host|server|address)\W*$", "host"),
    "card": (r"(?i)(card|visa|credit|account|pay)\W*$", "card"),
    "phone": (r"(?i)(tel|phone|call|fax|mobile|contact)\W*$", "call"),
}
#: Matches whose places are summed together.
CHUNK = 128
#: Whole-numbered features of a proposal; the number of their value vectors is bounded.
FEATURES = ("kind", "digits", "marks", "checked", "before", "after", "cue", "form", "tail")
#: More than any kind has ways of writing; standard errors by which held-out precision must exceed the one that is wanted.
WAYS, MARGIN = 16, 1.0
#: How a proposal is written, by kind: the first pattern that it has gives its ``form``.
FORMS = {
    "email": (r" \.|\. ", r"[(\[]at[)\]].*[(\[]dot[)\]]", r"[(\[]at[)\]].* dot ", r"[(\[]at[)\]]", " at .* dot ", r"[(\[]dot[)\]]", " at ", " "),
    "ip": (r"\[", r"\(", " "),
    "card": ("[/]", "[.]", "[ -]{2}"),
    "phone": (r"^\+", "^00", r"\(", "[.]", "-", "/"),
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        lambda i: F.coalesce(F.try_to_number(F.substring(turned, i, F.lit(1)), F.lit("9")).cast("int"), F.lit(0))
        * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    """The kind's check of a match."""
    digits = _digits(match)
    if kind == "ip":
        parts = F.transform(F.split(match, r"[^0-9]+"), lambda x: F.ltrim(x, F.lit("0")))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    # A base email passes as it is; one in words has letters behind its last dot and no blank beside a plain one.
    return ~match.rlike(r" \.|\. ") & (match.rlike("^[^ (\\[]*$") | match.rlike("(?:\\.|dot[)\\]]?) ?[A-Za-z]{2,24}$"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches, in code points.

    The gaps between matches and the matches give the places by running sums, in chunks
    of matches, as appending to one long array would take time by the square of it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)

    def cells(found: Column) -> Column:
        gap = F.transform(F.slice(gaps, 1, F.size(found)), F.length)
        return F.arrays_zip(gap.alias("gap"), F.transform(found, F.length).alias("size"), found.alias("match"))

    def chunks(cells: Column) -> Column:
        count = F.ceil(F.size(cells) / CHUNK).cast("int")
        each = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(cells, (i - 1) * CHUNK + 1, F.lit(CHUNK)))
        return F.when(count > 0, each).otherwise(F.slice(F.array(cells), 1, 0))

    def first_places(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["size"]))
        none = F.expr("named_struct('at', 0, 'out', cast(array() as array<int>))")
        summed = F.aggregate(
            lengths, none, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        )
        return summed["out"]

    def placed(chunk: Column, first: Column) -> Column:
        none = F.expr("cast(array() as array<struct<start: int, end: int, match: string>>)")

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + x["gap"]
            end = start + x["size"]
            span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(chunk, F.struct(first.alias("at"), none.alias("out")), step)["out"]

    def whole(chunks: Column) -> Column:
        return F.flatten(F.zip_with(chunks, first_places(chunks), placed))

    return _let(found, lambda f: _let(cells(f), lambda z: _let(chunks(z), whole)))


def _gated(kind: str, text: Column, loose: bool) -> Column:
    """Whether the text can hold a match at all; cheap, so that most texts meet no pattern."""
    if kind == "email":
        plain = F.contains(text, F.lit("@"))
        words = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")) | F.contains(text, F.lit(" at "))
        return plain | words if loose else plain
    if kind == "phone" and not loose:
        return F.contains(text, F.lit("+"))
    return F.col("numeric")


def _class(char: Column) -> Column:
    return F.when(F.coalesce(char, F.lit("")) == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike("^[A-Za-z0-9]"), 3).otherwise(2)


def _base_spans(kind: str) -> Column:
    k = F.lit(KINDS.index(kind))
    good = _located(F.col("text"), BASE[kind])
    if kind != "email":
        good = F.filter(good, lambda m: _passes(kind, m["match"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), k.alias("k"), m["end"].alias("end")))


def _key(k: Column, start: Column, end: Column) -> Column:
    """A span as one number, apart for texts of less than 2 ** 30 code points."""
    return (start.cast("long") * (1 << 32) + end.cast("long")) * len(KINDS) + k


def _features(kind: str) -> Callable[[Column], Column]:
    """From a match of ``kind``'s generator to a proposal; reads the columns ``text`` and ``base_keys``."""
    k = KINDS.index(kind)

    def features(m: Column) -> Column:
        # Digits and marks say nothing of an email but how long its names are.
        digits, marks = F.length(_digits(m["match"])), F.length(F.regexp_replace(m["match"], "[A-Za-z0-9]", ""))
        digits, marks = (F.lit(0) if kind == "email" else x for x in (digits, marks))
        same = F.array_contains("base_keys", _key(F.lit(k), m["start"], m["end"]))
        return F.struct(
            m["start"].alias("start"),
            F.lit(k).alias("k"),
            m["end"].alias("end"),
            same.cast("int").alias("label"),
            F.lit(k).alias("kind"),
            F.least(digits, F.lit(20)).alias("digits"),
            F.least(marks, F.lit(8)).alias("marks"),
            _passes(kind, m["match"]).cast("int").alias("checked"),
            F.when(m["start"] == 0, 0).otherwise(_class(F.substring(F.col("text"), m["start"], F.lit(1)))).alias("before"),
            _class(F.substring(F.col("text"), m["end"] + 1, F.lit(1))).alias("after"),
            F.substring(F.col("text"), F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24))).rlike(CUES[kind][0])
            .cast("int").alias("cue"),
            _form(kind, m["match"]).alias("form"),
            (_user(m["match"]) if kind == "email" else F.least(F.length(F.regexp_extract(m["match"], "[0-9]*$", 0)), F.lit(5))).alias("tail"),
        )

    return features


def _user(match: Column) -> Column:
    """Whether an email's name has marks or digits (2), or is a plain word, of up to three letters (0) or more (1)."""
    name = F.regexp_extract(match, "^[A-Za-z0-9._%+-]+", 0)
    return F.when(name.rlike("[^A-Za-z]"), 2).when(F.length(name) > 3, 1).otherwise(0)


def _form(kind: str, match: Column) -> Column:
    form = F.lit(0)
    for n, pattern in reversed(list(enumerate(FORMS[kind], 1))):
        form = F.when(match.rlike(pattern), n).otherwise(form)
    return form


def _copies(kind: str, match: Column) -> tuple[list[Column], list[Column]]:
    """Ways to write a base match past its pattern, and things that look like it but are none of its kind."""
    digits = _digits(match)
    if kind == "email":
        user, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
        dots = lambda mark: F.replace(host, F.lit("."), F.lit(mark))
        good = [("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", "."), ("@", "(dot)")]
        bad = [(" at ", ". "), ("@", ". "), (" at ", " . ")]
        # Names are of any kind where only data is written so, and not only pronouns where words are too.
        plain = [(name, at, dot) for name in ("jane", "bob") for at, dot in good if (name, at, dot) != ("bob", " at ", ".")]
        good, bad = ([F.concat(user, F.lit(at), dots(dot)) for at, dot in x] for x in (good, bad))
        good += [F.concat(F.lit(name), F.lit(at), dots(dot)) for name, at, dot in plain]
        # A plain word before a host is no name, nor is a pronoun after a cue.
        return good, [*bad, *(F.concat(F.lit(word), F.lit(" at "), host) for word in ("we shop", "he works", "we met", "to look", "us", "me"))]
    if kind == "ip":
        marks = ["[.]", "(.)", " . "]
        damaged = F.regexp_replace(match, "^[0-9]+", "777")
        return tuple([F.replace(x, F.lit("."), F.lit(m)) for m in marks] for x in (match, damaged))
    if kind == "card":
        wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.translate(F.right(digits, F.lit(1)), "0123456789", "1234567890"))
        return tuple([F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{m}") for m in ("", " ", "-", "/", ".", "--", " / ")] for x in (digits, wrong))
    bare, part = F.ltrim(match, F.lit("+")), lambda at, n: F.substring(digits, at, n)
    good = [bare, F.concat(F.lit("00"), bare), *(F.regexp_replace(bare, "[ ().-]+", m) for m in (".", "-", " ", "/"))]
    date = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    bad = [
        F.concat_ws(" ", date, part(1, 2)), F.replace(date, F.lit("-"), F.lit(".")), F.concat_ws(" ", part(1, 3), part(4, 3), part(7, 2)),
        *(F.concat_ws(m, part(1, 1), part(2, 3), part(5, 3), part(8, 3)) for m in (".", " ")),
        *(F.concat_ws(m, part(1, 3), part(4, 2), part(6, 4)) for m in ("-", " ", ".")),
        *(F.concat_ws(m, part(1, 2), part(3, 2), part(5, 2), part(7, 2), part(9, 2)) for m in (".", " ", "/", "-")),
    ]
    return good, bad


def _shape(kind: str, match: Column) -> Column:
    """A base match with the same features, the same for all matches that have them."""
    if kind == "email":
        name = F.when(_user(match) == 2, "jo.doe1").when(_user(match) == 1, "jane").otherwise("bob")
        host = F.substring_index(match, "@", -1)
        last = F.when(host.rlike("\\.[A-Za-z]{2,24}$"), "org").otherwise("9")
        labels = F.least(F.size(F.split(host, "\\.")) - 1, F.lit(3))
        return F.concat(name, F.lit("@"), F.repeat(F.lit("mail."), labels), last)
    # Zeros pass the check of cards, ones that of the others.
    return F.regexp_replace(match, "[0-9]", "0" if kind == "card" else "1")


def _near(kind: str, before: Column, after: Column) -> tuple[Column, Column]:
    """Surroundings with the same features."""
    char = F.right(before, F.lit(1))
    mark = F.when(_class(char) == 0, "").when(_class(char) == 1, " ").when(_class(char) == 2, "-").otherwise("x")
    word = F.when(before.rlike(CUES[kind][0]), CUES[kind][1]).when(_class(char) == 0, "").otherwise("we")
    followed = F.regexp_replace(F.regexp_replace(F.regexp_replace(after, "[A-Za-z]", "a"), "[0-9]", "1"), "\\s", " ")
    return F.concat(word, F.when((_class(char) == 3), F.lit("")).otherwise(mark)), followed


def _taught(found: DataFrame, folds: int) -> DataFrame:
    """(held, label, features, n): proposals at the copies of base spans, those in the texts that fail their check, and plain
    words ``at`` a host in texts without a base email.
    """
    held = F.coalesce((F.crc32(F.col("id").cast("string").cast("binary")) % folds) == 0, F.lit(False)).alias("held")
    other = f"p.checked = 0 OR (p.k = 0 AND p.form = {FORMS['email'].index(' at ') + 1} AND p.cue = 0 AND p.tail < 2 AND NOT exists(base, b -> b.k = 0))"
    apart = f"filter(proposed, p -> p.label = 0 AND ({other}) AND NOT exists(base, b -> b.start < p.end AND p.start < b.end))"
    one = F.lit(1).cast("long").alias("n")
    parts = [found.select(held, F.explode(F.expr(apart)).alias("p")).select("held", *(f"p.{f}" for f in ("label", *FEATURES)), one)]
    cuts = found.select(held, F.explode("cuts").alias("c")).select("held", "c.*")
    for k, kind in enumerate(KINDS):
        good, bad = _copies(kind, F.col("match"))
        copies = F.array(*(F.struct(F.lit(x).alias("good"), c.alias("copy")) for x, cs in ((1, good), (0, bad)) for c in cs))
        before, after = _near(kind, F.col("before"), F.col("after"))
        shapes = cuts.where(F.col("k") == k).groupBy("held", before.alias("before"), _shape(kind, F.col("match")).alias("match"), after.alias("after"))
        rows = shapes.agg(F.count("*").alias("n")).select("held", "n", "before", "after", F.explode(copies).alias("v"))
        rows = rows.select(
            "held", "n", "v.good", F.length("before").alias("from"), (F.length("before") + F.length("v.copy")).alias("to"),
            F.concat("before", "v.copy", "after").alias("text"), F.expr("cast(array() as array<long>)").alias("base_keys"),
        )
        proposed = F.explode(F.transform(_located(F.col("text"), LOOSE[kind]), _features(kind))).alias("p")
        rows = rows.select("held", "n", "good", "from", "to", proposed)
        # A damaged copy stands for all that is proposed of it, a good one only for itself.
        exact, meets = "p.start = from AND p.end = to", "p.start < to AND p.end > from"
        rows = rows.where(f"CASE WHEN good = 1 THEN {exact} ELSE {meets} END")
        parts.append(rows.select("held", F.col("good").alias("label"), *(f"p.{f}" for f in FEATURES), "n"))
    return reduce(DataFrame.unionAll, parts)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, proposed, cuts): base spans, proposals with features and whether they are base spans, and all
    base spans of the text with their surroundings.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("numeric", F.col("text").rlike("[0-9]"))
    base, loose = [], []
    empty_base = F.expr("cast(array() as array<struct<start: int, k: int, end: int>>)")
    for kind in KINDS:
        base.append(F.when(_gated(kind, F.col("text"), False), _base_spans(kind)).otherwise(empty_base))
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))
    rows = rows.withColumn("base_keys", F.transform("base", lambda b: _key(b["k"], b["start"], b["end"])))
    empty = F.expr(
        "cast(array() as array<struct<start: int, k: int, end: int, label: int, "
        + ", ".join(f"{f}: int" for f in FEATURES)
        + ">>)"
    )
    for kind in KINDS:
        proposed = F.transform(_located(F.col("text"), LOOSE[kind]), _features(kind))
        loose.append(F.when(_gated(kind, F.col("text"), True), proposed).otherwise(empty))
    near = lambda at, to: F.substring(F.col("text"), at + 1, to - at)
    cuts = F.transform(
        "base",
        lambda b: F.struct(
            b["k"].alias("k"),
            near(F.greatest(b["start"] - 24, F.lit(0)), b["start"]).alias("before"),
            near(b["start"], b["end"]).alias("match"),
            near(b["end"], b["end"] + 2).alias("after"),
        ),
    )
    return rows.select("id", "base", F.concat(*loose).alias("proposed"), cuts.alias("cuts"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98, folds: int = 5
) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added.

    The counts and ``base_sha256`` are of base spans; ``spans`` has them and the
    added ones, each as kind:start:end in code points, end exclusive, for texts of
    less than 2 ** 30 code points. Null and empty texts have none; repeated rows get
    equal results; a null id trains like others; other columns are ignored. Without
    base spans to learn from nothing is added. ``precision`` is what the added spans of
    each way of writing must reach, at the lower end of their margin of error, on
    held-out documents (crc32 of the id mod ``folds`` is 0). Trees learn from every base
    span of every text.
    """
    found = materialize(find_spans(docs, id_col, text_col), "pii-spans")
    each = _taught(found, folds)
    # A row per value vector of FEATURES, whatever the corpus: of 4 kinds with up to 21 * 9 * 2 * 4 * 4 * 2 * 9 * 6 values, mostly some hundreds.
    table = each.groupBy("held", "label", *FEATURES).agg(F.sum("n").alias("n")).orderBy("held", "label", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in table], dtype=np.int64).reshape(-1, len(FEATURES))
    n, label, out = (np.array([r[c] for r in table], dtype=float) for c in ("n", "label", "held"))
    train, test = out == 0, out == 1
    limits: dict[int, float] = {}
    trees = boost(x[train], (n * label)[train], (n * (1 - label))[train]) if label[train].any() else []
    if trees:
        total = np.sum([t.value(x) for t in trees], axis=0)
        way = x[:, 0] * WAYS + x[:, FEATURES.index("form")]
        for w in np.unique(way[test]):
            rows = test & (way == w)
            cut = calibrated_cut(total[rows], (n * label)[rows], (n * (1 - label))[rows], precision, MARGIN)
            if np.isfinite(cut):
                limits[int(w)] = cut
    added = F.slice(F.col("proposed"), 1, 0)
    if limits:
        names = [f"p.{f}" for f in FEATURES]
        total_sql = " + ".join(t.sql(names) for t in trees)
        cuts = " ".join(f"WHEN {w} THEN {cut - 1e-6:.9f}D" for w, cut in limits.items())
        chosen = f"({total_sql}) >= CASE p.kind * {WAYS} + p.form {cuts} ELSE double('infinity') END"
        apart = "NOT exists(base, b -> b.start < p.end AND p.start < b.end)"
        added = F.expr(f"filter(proposed, p -> p.label = 0 AND {chosen} AND {apart})")
    base, every = F.col("base"), F.col("every")
    spans = F.transform(added, lambda p: F.struct(p["start"].alias("start"), p["k"].alias("k"), p["end"].alias("end")))
    rows = found.withColumn("every", F.array_sort(F.concat(base, spans)))
    return rows.select(
        F.col("id").alias(id_col),
        *(F.expr(f"cast(size(filter(base, b -> b.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(every).cast("long").alias("n_spans"),
        (F.size(every) - F.size(base)).cast("long").alias("n_added"),
    )

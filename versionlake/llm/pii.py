"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides.

DataFrame functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import query, table, text_of, written

# The base patterns. Possessive quantifiers find the same matches and never go back over long runs.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "secret")

# Field names of secrets; shapes of numbers that are written in groups.
FIELDS = ["password", "passwort", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key",
          "private_key", "contraseña", "passport", "ssn", "iban"]
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}(?:[\x20-]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

# A candidate is what follows a field name: after = or : any run without white space, else one with a digit in it; without
# any digit it must look like WORDS (neither a short word nor a call or path of a program). Or, anywhere, a number in
# groups, or a run of letters and digits of at least LEAST characters with a digit in it.
LEAST = 10
WORDS = r"^[^()\[\]{}.]{12,}$"
_GROUPED = rf"(?:{SSN}|{IBAN})"
_RUN = r"(?!(?i:https?)://)[^\s\"'<>,;]{3,}(?<![.:!?)])"
_FIELD = rf"(?i:(?=[{''.join(sorted({f[0] for f in FIELDS}))}])(?:{'|'.join(FIELDS)}))[\"']?"
_SIGN = r"[\x20\t]*+[=:][\x20\t]*+[\"']?"
_SPACE = r"[\x20\t]++[\"']?"
LED = rf"{_FIELD}(?:{_SIGN}(?:{_GROUPED}|{_RUN})|{_SPACE}(?:{_GROUPED}|(?=[^\s\"'<>,;0-9]*+[0-9]){_RUN}))"
LEADER = rf"^{_FIELD}(?:{_SIGN}|{_SPACE})"
CANDIDATE = rf"{LED}|(?<![A-Za-z0-9])(?:(?<!-){_GROUPED}|(?=[A-Za-z0-9]{{{LEAST}}})[A-Za-z]*+[0-9][A-Za-z0-9]*+)"
#: Code points before a candidate that its labelers see.
CONTEXT = 24

#: Rounds of the estimation, first guess of the share of true candidates and of a labeler's right votes.
ROUNDS = 12
PRIOR = 0.3
RIGHT = 0.8
#: A labeler keeps at least this chance of any vote, so that no single vote decides however large the data.
WRONG = 0.02
LABELERS = ("shape", "field", "sign", "spread")


def matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, value, before>> of the leftmost non-overlapping matches; before: the text since the last."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("value"))
    empty = F.array().cast("array<struct<start: int, end: int, value: string, before: string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state, pair):
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["value"])
        entry = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"),
                         F.right(pair["piece"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(entry)).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, first, step, lambda s: s["out"])).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn sum."""
    marks = F.split(F.reverse(digits), "")
    doubled = F.transform(marks, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """ARRAY<STRUCT<start, kind, end>> of the base kinds, in order; failing matches are dropped without a second try."""
    def digits(m):
        return F.regexp_replace(m["value"], "[^0-9]", "")

    def count(m):
        return F.length(digits(m))

    parts = []
    rules = [(EMAIL, "@", lambda m: F.lit(True)),
             (IP, ".", lambda m: F.rlike(m["value"], F.lit(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"))),
             (CARD, None, lambda m: count(m).between(14, 19) & luhn(digits(m))),
             (PHONE, "+", lambda m: count(m).between(10, 15))]
    for kind, (pattern, sign, good) in enumerate(rules):
        # a text without the sign that every match holds is not searched
        searched = F.when(F.contains(text, F.lit(sign)), text).otherwise("") if sign else text
        parts.append(_of_kind(F.filter(matches(searched, pattern), good), kind))
    return F.array_sort(F.concat(*parts))


def votes_and_features(c: Column) -> dict[str, Column]:
    """Votes of the labelers (1, 0, -1) and the categories that the span classifier sees, for a candidate."""
    value, before = c["value"], F.lower(c["before"])
    letters = F.rlike(value, F.lit("[A-Za-z]"))
    digits = F.rlike(value, F.lit("[0-9]"))
    plain = F.rlike(value, F.lit("^[A-Za-z0-9]+$"))
    hexa = F.rlike(value, F.lit("^[0-9a-fA-F]+$"))
    field = F.rlike(before, F.lit(rf"(?:{'|'.join(FIELDS)})[\"']?[\x20\t]*[=:]?[\x20\t]*[\"']?$"))
    sign = F.rlike(before, F.lit("[=:][\\x20\\t]*[\"']?$"))
    changes = F.size(F.split(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1))
    size = F.length(value)

    def named(name: str, shape: str) -> Column:
        return F.rlike(before, F.lit(rf"{name}[^a-z0-9]*$")) & F.rlike(value, F.lit(shape))

    # the format of the field before, or of a number written in groups
    fits = (F.rlike(value, F.lit(rf"^(?:{SSN}|{IBAN})$")) & (F.contains(value, F.lit("-")) | F.contains(value, F.lit(" ")))
            | named("ssn", "^[0-9]{9}$") | named("passport", "^(?=.*[0-9])[A-Za-z0-9]{6,9}$") | named("iban", rf"^{IBAN}$"))
    return {
        # regex: a known format, mixed letters and digits of some length, a value with signs and a digit
        "shape": F.when(fits | letters & digits & (hexa | (size >= 16) | ~plain), 1)
        .when(letters & (digits | (size >= 16)), 0).otherwise(-1),
        # gazetteer: a field name of secrets just before
        "field": F.when(field, 1).otherwise(-1),
        # context: an assignment just before
        "sign": F.when(sign, 1).otherwise(-1),
        # spread: letters and digits change often; nothing to say on formats and on values with signs or without digits
        "spread": F.when(fits | ~plain | ~digits, 0).when(changes >= 6, 1).when(changes >= 3, 0).otherwise(-1),
        "kind_of": F.when(fits, "format").when(~digits, "words").when(~letters, "digits").when(hexa, "hex")
        .when(plain, "mixed").otherwise("signs"),
        "length_of": F.when(fits, "given").when(size < 14, "short").when(size < 20, "middle").otherwise("long"),
        "left_of": F.when(field & sign, "assigned").when(field, "named").when(sign, "sign").otherwise("text"),
    }


FEATURES = ("kind_of", "length_of", "left_of")


def candidates(text: Column, base: Column) -> Column:
    """Candidates that meet no base span: the value alone, with what leads to it as the text before."""
    searched = F.when(F.rlike(text, F.lit(r"[0-9=:]")), text).otherwise("")

    def value_of(m):
        lead = F.regexp_extract(m["value"], LEADER, 0)
        long = F.length(lead)
        return F.struct((m["start"] + long).alias("start"), m["end"].alias("end"),
                        F.substr(m["value"], long + 1).alias("value"),
                        F.when(long > 0, lead).otherwise(m["before"]).alias("before"))

    def taken(c):
        return (F.rlike(c["value"], F.lit("[0-9]")) | F.rlike(c["value"], F.lit(WORDS))) & ~F.exists(
            base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    return F.filter(F.transform(matches(searched, CANDIDATE), value_of), taken)


def _between(x: float) -> float:
    return min(0.999, max(0.001, x))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`patterns` with the posterior that their candidates are personal data, by expectation-maximisation.

    A labeler has for true and for false candidates a chance of each vote. Patterns are few whatever the size of the data,
    at most 3 per labeler multiplied; each round is an aggregate over them, and only sums come to the driver.
    """
    chances = {(name, truth, vote): (RIGHT if vote == truth else (1 - RIGHT) / 2) for name in LABELERS
               for truth in (1, -1) for vote in (1, 0, -1)}
    prior = PRIOR

    def posterior() -> Column:
        side = {}
        for truth, share in ((1, prior), (-1, 1 - prior)):
            value = F.lit(_between(share))
            for name in LABELERS:
                value = value * F.when(F.col(name) == 1, F.lit(chances[name, truth, 1])).when(
                    F.col(name) == 0, F.lit(chances[name, truth, 0])).otherwise(F.lit(chances[name, truth, -1]))
            side[truth] = value
        return side[1] / (side[1] + side[-1])

    for _ in range(rounds):
        weighed = patterns.withColumn("yes", F.col("n") * posterior()).withColumn("no", F.col("n") - F.col("yes"))
        sums = [F.sum("yes").alias("yes"), F.sum("no").alias("no")]
        for name in LABELERS:
            for vote in (1, 0, -1):
                for truth in ("yes", "no"):
                    sums.append(F.sum(F.when(F.col(name) == vote, F.col(truth)).otherwise(0.0)).alias(
                        f"{name}{vote}{truth}"))
        row = weighed.agg(*sums).first()
        if not (row["yes"] or row["no"]):
            break
        prior = _between(row["yes"] / (row["yes"] + row["no"]))
        for name in LABELERS:
            for vote in (1, 0, -1):
                for truth, side in ((1, "yes"), (-1, "no")):
                    # a little of the first guess stays, so that a vote never seen keeps a chance
                    start = 2.0 * (RIGHT if vote == truth else (1 - RIGHT) / 2)
                    chances[name, truth, vote] = max(WRONG, (row[f"{name}{vote}{side}"] + start) / (row[side] + 2.0))
    return patterns.withColumn("posterior", posterior())


def train_classifier(docs: DataFrame, text_col: str = "text") -> dict[tuple[str, str], float]:
    """Log-odds of each category of each feature and of the whole ("", ""), from all candidates of all documents.

    The classifier is naive Bayes over the categories, trained on the posteriors of the votes as soft labels. Its categories
    are coarser than the votes in places (what stands on the left) and finer in others (kinds and lengths of values).
    """
    text = text_of(docs, text_col)
    spans = docs.select(F.explode(candidates(text, base_spans(text))).alias("c"))
    seen = votes_and_features(F.col("c"))
    counts = written(spans.select(*[v.alias(k) for k, v in seen.items()])
                     .groupBy(*seen).agg(F.count("*").cast("double").alias("n")).coalesce(1))
    patterns = counts.groupBy(*LABELERS).agg(F.sum("n").alias("n")).coalesce(1)
    judged = counts.join(estimate(written(patterns)).drop("n"), list(LABELERS))
    soft = judged.withColumn("yes", F.col("n") * F.col("posterior")).withColumn("no", F.col("n") - F.col("yes"))
    sums = written(soft)
    total = sums.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    yes, no = (total["yes"] or 0.0) + 1.0, (total["no"] or 0.0) + 1.0
    out = {("", ""): math.log(yes / no)}
    for feature in FEATURES:
        for row in sums.groupBy(feature).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect():
            out[feature, row[feature]] = math.log(
                ((row["yes"] + 0.5) / (yes + 1.5)) / ((row["no"] + 0.5) / (no + 1.5)))
    return out


def find_pii(docs: DataFrame, text_col: str = "text", base_col: str = "base", spans_col: str = "spans") -> DataFrame:
    """All of `docs` with base and spans (names `base_col`, `spans_col`): ARRAY<STRUCT<start, kind, end>>, kind a number in KINDS.

    Base spans come from the base patterns. The method adds secrets: candidates that meet no base span and that the span
    classifier takes for personal data. A value after a field name is one candidate, whatever signs it holds; white space,
    quotes, commas, semicolons and angle brackets end it. Not candidates: values of less than three characters, or of less
    than 12 without a digit. Of overlapping candidates the leftmost counts. Texts of any length are searched whole. Null is the empty text and has no spans. Rows are independent but for the training
    of the classifier, which counts all candidates of all rows; repeated rows, null ids and other columns do no harm,
    and columns of those two names are replaced. An empty table gives no rows, one without candidates a classifier that
    takes none.
    """
    weights = train_classifier(docs, text_col)

    def is_secret(c: Column) -> Column:
        seen = votes_and_features(c)
        odds = F.lit(weights["", ""])
        for feature in FEATURES:
            part = F.lit(-2.0)
            for (name, category), weight in weights.items():
                if name == feature:
                    part = F.when(seen[feature] == category, F.lit(weight)).otherwise(part)
            odds = odds + part
        return odds > 0

    text = text_of(docs, text_col)
    rows = docs.withColumn(base_col, base_spans(text))
    more = _of_kind(F.filter(candidates(text, F.col(base_col)), is_secret), KINDS.index("secret"))
    return rows.withColumn(spans_col, F.array_sort(F.concat(base_col, more)))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """`docs` of `find_pii` with each span replaced by its kind in angle brackets; of overlapping spans the first counts.

    A null text stays null.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col(text_col)
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        skip = s["start"] < state["at"]
        piece = F.concat(state["out"], F.substr(text, state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.struct(F.when(skip, F.greatest(state["at"], s["end"])).otherwise(s["end"]).alias("at"),
                        F.when(skip, state["out"]).otherwise(piece).alias("out"))

    clean = F.aggregate(spans_col, first, step, lambda s: F.concat(
        s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(text))


@query("op6_pii")
def op6_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[n(k) for k in KINDS[:4]], F.sha2(span_text(F.col("base")).cast("binary"), 256).alias(
        "base_sha256"), span_text(F.col("spans")).alias("spans"))

"""Secret scanning through a trigram inverted index (DataFrame operations only).

Each rule's regular expression is reduced to a Boolean trigram query: alternatives of literal strings,
each of which needs all of its trigrams. The index holds the postings of the trigrams that the rules
name; alternatives intersect their postings, and only candidate texts are verified with the expression.
Rules without a mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, key_filter, maybe_in, whole_text


@dataclass(frozen=True)
class Rule:
    """One kind of secret: matches of ``pattern``, leftmost first, of which those that also match ``keep`` count.

    ``keep`` is matched against the whole found string. ``prefilter`` is a cheaper expression that every
    text with a counting match contains; it serves the rules that scan fully.
    """

    kind: str
    pattern: str
    keep: str
    prefilter: str | None = None


#: The kinds in the order in which spans at the same place are listed.
RULES = (
    Rule(
        "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""(?s)^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}$"""
    ),
    Rule("access", r"AKIA[A-Z0-9]+", r"^.{18,}$"),
    Rule("hex", r"[0-9a-f]{16,}", r"^.{16,}$", r"[0-9a-f]{16}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"^.*$"),
)
BASE_KINDS = ("assign", "access", "hex")


def _sequences(pattern: str) -> list[list[str]] | None:
    """The alternatives of a simple expression, each as the literal runs that any match holds; None if not simple.

    Understands literals, groups of alternatives, optional characters and classes: enough for rules as
    above. Whatever else occurs ends a run and adds nothing.
    """
    tokens = re.findall(
        r"\(\?i:|\(\?:|\(|\)|\||\[\^?\]?[^\]]*\]|\\x[0-9A-Fa-f]{2}|\\.|\{[^}]*\}|[?*+]|.", pattern, re.S
    )
    at = 0

    def alternatives() -> list[list[str]]:
        nonlocal at
        out: list[list[str]] = []
        runs: list[list[str]] = [[""]]
        while at < len(tokens) and tokens[at] != ")":
            token = tokens[at]
            at += 1
            if token == "|":
                out += runs
                runs = [[""]]
                continue
            if token.startswith("("):
                inner = alternatives()
                at += 1
                literal = True
            elif token.startswith("[") or token == "." or (
                token.startswith("\\") and not token.startswith("\\x") and token[1].isalnum()
            ):
                inner, literal = [["", ""]], False
            else:
                inner, literal = [[chr(int(token[2:], 16)) if token.startswith("\\x") else token[-1]]], True
            times = tokens[at] if at < len(tokens) and (tokens[at] in "?*+" or tokens[at].startswith("{")) else ""
            at += bool(times)
            if times in ("?", "*") or times.startswith("{0") or times.startswith("{,"):
                # may be absent: with single characters both readings are followed, else the run ends
                inner = [[""]] + inner if times == "?" and literal else [["", ""]]
            elif times:
                inner = [[*x, ""] for x in inner]
            runs = [[*r[:-1], r[-1] + x[0], *x[1:]] for r in runs for x in inner]
        return out + runs

    return alternatives()


def trigram_query(pattern: str) -> list[list[str]]:
    """Alternatives of trigrams (lower-cased) of which any match holds all of one alternative; [] if none is mandatory."""
    out = []
    for runs in _sequences(pattern) or []:
        need = {run.lower()[i:i + 3] for run in runs for i in range(len(run) - 2)}
        if not need:
            return []
        if sorted(need) not in out:
            out.append(sorted(need))
    return out


def match_rows(texts: DataFrame, rule: Rule) -> DataFrame:
    """(_id, _row, start, end) of the rule's counting matches in ``_text``, in code points, end exclusive.

    Every match is a row of its own with the text before it, and its place is a running sum of their
    lengths, so a text with very many matches costs no more than its length. Repeated texts of an id count once.
    """
    found, between = F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(0)), F.split("_text", rule.pattern, -1)
    pieces = texts.select(
        "_id", "_row",
        F.posexplode(
            F.arrays_zip(found.alias("found"), F.slice(between, F.lit(1), F.size(between) - 1).alias("before"))
        ).alias("pos", "m")
    )
    sizes = pieces.select(
        "_id", "_row", "pos", F.length("m.before").alias("_before"), F.length("m.found").alias("_found"),
        F.col("m.found").rlike(rule.keep).alias("_ok")
    ).dropDuplicates(["_id", "_row", "pos"])
    end = F.sum(F.col("_before") + F.col("_found")).over(
        Window.partitionBy("_id", "_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ).cast("int")
    return sizes.withColumn("end", end).filter("_ok").select(
        "_id", "_row", (F.col("end") - F.col("_found")).alias("start"), "end"
    )


def postings(rows: DataFrame, trigrams: list[str], keys: list[str]) -> DataFrame:
    """The inverted index over ``trigrams``: a row (trigram, *keys) per text that holds it, case ignored."""
    low = rows.withColumn("_low", F.lower("_text"))
    held = F.filter(
        F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull()
    )
    return low.select(*keys, F.explode(held).alias("trigram"))


def scan_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's secrets: id and ``found``, an array of (start, rank, kind, end) in order of start, then rule.

    Offsets count code points, ends exclusive. Null counts as empty. Rows that repeat an id and a text each
    get the same result; a null id stays null. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")
    ).withColumn("_row", F.xxhash64("_text"))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    clauses = [(rule.kind, i, clause) for rule in rules for i, clause in enumerate(queries[rule.kind])]
    needed = sorted({t for _, _, clause in clauses for t in clause})

    def verified(texts: DataFrame, rule: Rule) -> DataFrame:
        rank = [r.kind for r in rules].index(rule.kind)
        return match_rows(texts, rule).select(
            "_id", "_row",
            F.struct("start", F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), "end").alias("span")
        )

    parts = [
        verified(
            rows.filter(F.col("_text").rlike(rule.prefilter or rule.pattern)), rule
        ) for rule in rules if not queries[rule.kind]
    ]
    if needed:
        index = durable(postings(rows, needed, ["_id", "_row"]), "trigram-postings")
        # the trigrams a text holds, out of a fixed few, so a group is at most that many distinct values
        held = index.groupBy("_id", "_row").agg(F.collect_set("trigram").alias("_held"))
        fits = [
            F.when(
                F.size(F.array_intersect("_held", F.array(*map(F.lit, clause)))) == len(clause), F.lit(kind)
            ) for kind,
            _, clause in clauses
        ]
        kinds = F.array_distinct(F.filter(F.array(*fits), lambda k: k.isNotNull()))
        candidates = durable(
            held.select("_id", "_row", kinds.alias("_kinds")).filter(F.size("_kinds") > 0), "secret-candidates"
        )
        near = maybe_in(
            rows, F.struct("_id", "_row"), key_filter(candidates.select(F.struct("_id", "_row").alias("_key")), "_key"),
            "_maybe"
        ).filter("_maybe")
        wanted = candidates.select(F.col("_id").alias("_cid"), F.col("_row").alias("_crow"), "_kinds")
        joined = near.join(wanted, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_row") == F.col("_crow")))
        parts += [
            verified(joined.filter(F.array_contains("_kinds", rule.kind)), rule) for rule in rules if queries[rule.kind]
        ]
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    by_row = durable(spans, "secret-spans").groupBy(
        F.col("_id").alias("_sid"), F.col("_row").alias("_srow")
    ).agg(F.array_sort(F.collect_set("span")).alias("found"))
    out = rows.select("_id", "_row").join(
        by_row, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_row") == F.col("_srow")), "left"
    )
    none = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    return out.select(F.col("_id").alias(id_col), F.coalesce("found", none).alias("found"))


def spans_text(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ","
    )

"""Quality rules in a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document: the ledger holds the measurements
and one bit for each rule that fails. A versioned policy is a mask over these
bits; verdicts and ablations are bit operations on the ledger and never touch
a text again. A rule's bit is its place in RULES: new rules are appended, so
ledgers stored earlier keep their meaning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm import common

SPACES = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A name and the SQL condition over the measurements under which a document fails."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 10 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the rules of which a document may fail `allowed` at most."""

    version: int
    rules: tuple[str, ...]
    allowed: int = 0

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        place = {r.name: k for k, r in enumerate(rules)}
        return sum(1 << place[name] for name in set(self.rules))

    def keeps(self, bits: Column, rules: tuple[Rule, ...] = RULES) -> Column:
        return F.bit_count(bits.bitwiseAND(F.lit(self.mask(rules)).cast("long"))) <= self.allowed


BASE = Policy(1, ("few_words", "repeated_words"))
POLICIES = (BASE, Policy(2, tuple(r.name for r in RULES)), Policy(3, tuple(r.name for r in RULES), allowed=1))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value being computed once however often body reads it."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column, width: int) -> Column:
    """Words covered by windows (their hashes in order) of `width` words that occur twice or more."""

    def of_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct((x + width).alias("upto"), (a["n"] + x + width - F.greatest(a["upto"], x)).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    paired = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(paired, of_sorted))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in windows of `width` words found twice or more; windows are told apart by their XXH64."""

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)]))
        return F.when(F.size(w) <= width, 0).otherwise(_let(windows, lambda h: _covered(h, width)))

    return _let(words, of_words)


def measurements(text: Column) -> Column:
    """A struct of MEASURES of a text, as longs. A null text has the measures of an empty one."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, f"{SPACES}+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        counted = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
        parts = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again")))
        found = {
            "n_words": lambda p, x: p["n"],
            "word_chars": lambda p, x: F.char_length(t) - F.regexp_count(t, F.lit(SPACES)),
            "n_symbols": lambda p, x: F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
            "n_lines": lambda p, x: x["n"],
            "n_dup_lines": lambda p, x: x["again"],
            "n_repeat_words": lambda p, x: p["again"],
        }
        return _let(parts, lambda p: _let(counted, lambda x: F.struct(*[found[m](p, x).cast("long").alias(m) for m in MEASURES])))

    return _let(text, of)


def _bits(rules: tuple[Rule, ...]) -> Column:
    """The failure bits, over columns named like MEASURES."""
    out = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        out = out.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return out


def evaluate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: doc_id, MEASURES and bits (long, bit k: rules[k] fails) of each row, saved in the shared folder.

    One row per input row, repeated and null ids included; a null text measures
    as an empty one, and other columns are ignored whatever their names. An
    empty table gives an empty ledger. A text of any length is one value of one
    row; nothing is shuffled.
    """
    if len(rules) > 63:
        raise ValueError("a ledger has room for 63 rules")
    measured = docs.select(F.col(id_col).cast("long").alias("doc_id"), measurements(F.col(text_col)).alias("m")).select("doc_id", "m.*")
    return common.save(measured.withColumn("bits", _bits(rules)), "ledger")


def verdicts(ledger: DataFrame, policies: Iterable[Policy], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a boolean column kept_v<version> for each policy."""
    return ledger.withColumns({f"kept_v{p.version}": p.keeps(F.col("bits"), rules) for p in policies})


def ablations(ledger: DataFrame, policies: Iterable[Policy] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per policy and rule of it, from the ledger's bits alone.

    version, rule, n_docs, n_kept (by the whole policy), n_failed (documents
    that fail the rule), n_kept_without (kept by the policy without the rule)
    and implied (bits that all documents which fail the rule have; null where
    none does). An empty ledger gives no rows. Documents are first counted by
    their bits, so no more rows go on than there are patterns of failed rules.
    """
    place = {r.name: k for k, r in enumerate(rules)}
    long = lambda x: F.lit(x).cast("long")
    wanted = [F.struct(F.lit(p.version).alias("version"), F.lit(name).alias("rule"), long(1 << place[name]).alias("bit"), long(p.mask(rules)).alias("mask"), F.lit(p.allowed).alias("allowed")) for p in policies for name in sorted(set(p.rules))]
    patterns = ledger.groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    each = patterns.select("bits", "n", F.explode(F.array(*wanted)).alias("r")).select("bits", "n", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    mine = F.col("bits").bitwiseAND(F.col("mask"))
    without = mine.bitwiseAND(F.bitwise_not("bit"))
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(F.bit_count(mine) <= F.col("allowed")).alias("n_kept"),
        total(fails).alias("n_failed"),
        total(F.bit_count(without) <= F.col("allowed")).alias("n_kept_without"),
        F.bit_and(F.when(fails, F.col("bits"))).alias("implied"),
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES[1], rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the policy keeps; measured in the same pass, nothing is stored."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("weft_row")
    marked = docs.select(row, measurements(F.col(text_col)).alias("m")).select("weft_row", "m.*")
    return marked.where(policy.keeps(_bits(rules), rules)).select("weft_row.*")

"""URL filtering by rules and, where none fits, by a ratio of two character language models.

One model is learned from the URLs that rules allow, the other from those they block. Both are variable-order Markov models: a
character's probability after up to three others, Witten-Bell smoothed towards the shorter contexts. A URL without a rule is
blocked if the mean difference of its characters' log-likelihoods lies below a cut that is calibrated on URLs with a
rule that neither model has seen. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, stored

#: Characters that the models tell apart; all others are one more. With the two marks, 4-grams number under 6 million however many URLs there are.
ALPHABET = "a-z0-9./_?=&#%:-"
START, END, ELSE = "^", "$", "~"
ORDER = 4
#: Weights of 4-grams are broadcast up to this number (under 100 bytes each), beyond it they are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Log-likelihood differences are calibrated in steps of 1 / STEPS between -LIMIT and LIMIT.
STEPS, LIMIT = 100, 20

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty for null urls and those without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does. Of equally long ones the first in alphabetical order wins."""
    name = verdict = None
    for says, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(start)
        name = F.when(fits, of + start) if name is None else name.when(fits, of + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def _text(url: Column) -> Column:
    """What the models read: the url after its scheme, lower-cased, in a closed alphabet, between marks."""
    plain = F.regexp_replace(F.translate(_after_scheme(url), _UPPER, _LOWER), f"[^{ALPHABET}]", ELSE)
    return F.concat(F.lit(START * (ORDER - 1)), plain, F.lit(END))


def _grams(rows: DataFrame, *more: Column) -> DataFrame:
    """A row for each 4-gram of rows' text, with more. The text's characters are split once, so long urls take time in proportion."""
    chars = rows.withColumn("chars", F.split("text", ""))
    gram = F.transform(F.sequence(F.lit(1), F.length("text") - (ORDER - 1)), lambda k: F.concat(*(F.element_at("chars", k + d) for d in range(ORDER))))
    return chars.select(*more, F.explode(gram).alias("gram"))


def _weights(grams: DataFrame) -> DataFrame:
    """grams: gram, allow, block (counts in the two classes). Per gram its weight: log P(allow) - log P(block) of its last character."""
    sides = ("allow", "block")
    lower = None
    for n in range(1, ORDER + 1):
        own = grams.groupBy(F.substr("gram", F.lit(ORDER + 1 - n)).alias("gram")).agg(*(F.sum(s).alias(s) for s in sides)) if n < ORDER else grams
        context = Window.partitionBy(F.substr("gram", F.lit(1), F.lit(n - 1)))
        for s in sides:
            own = own.withColumn(f"{s}_n", F.sum(s).over(context)).withColumn(f"{s}_t", F.sum((F.col(s) > 0).cast("int")).over(context))
        if lower is None:
            # Add-one over the characters that occur; the window is over one row for each character.
            size = F.count(F.lit(1)).over(context)
            p = {s: (F.col(s) + 1) / (F.col(f"{s}_n") + size) for s in sides}
        else:
            own = own.withColumn("tail", F.substr("gram", F.lit(2))).join(lower, "tail")
            # A context that a class never had says nothing: the shorter one's probability stays.
            p = {s: F.when(F.col(f"{s}_n") == 0, F.col(f"{s}_p")).otherwise((F.col(s) + F.col(f"{s}_t") * F.col(f"{s}_p")) / (F.col(f"{s}_n") + F.col(f"{s}_t"))) for s in sides}
        if n == ORDER:
            return own.select("gram", (F.log(p["allow"]) - F.log(p["block"])).alias("weight"))
        lower = own.select(F.col("gram").alias("tail"), *(p[s].alias(f"{s}_p") for s in sides))
    raise AssertionError


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict, score (the mean difference; null where no model could be learned).

    Null urls and urls without `://` have an empty host and path, fit no rule and are judged as an empty text. Repeated
    rows are repeated; further columns are ignored; an empty table gives no rows. If rules allow or block
    nothing, there is nothing to compare and urls without a rule are allowed. A URL trains a class as often as it occurs.
    """
    url = F.col(url_col).cast("string")
    slim = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"))
    slim = slim.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    slim = slim.withColumn("rule", rule).withColumn("says", says)
    # Equal urls always are on the same side of the split; five of sixteen calibrate.
    slim = slim.withColumn("aside", F.substr(F.md5(F.coalesce("url", F.lit("")).cast("binary")), F.lit(1), F.lit(1)) < "5")
    slim = slim.withColumn("row", F.monotonically_increasing_id()).withColumn("text", _text(F.col("url")))
    learns = lambda s: ((F.col("says") == s) & ~F.col("aside")).cast("long")
    grams = _grams(slim, *(F.coalesce(learns(s), F.lit(0)).alias(s) for s in ("allow", "block")))
    grams = stored(grams.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count(F.lit(1)).alias("n")), "grams")
    weights = stored(_weights(grams.select("gram", "allow", "block")), "weights")
    own = ("id", "host", "path", "rule", "says", "aside")
    if weights.count() <= MOST_BROADCAST:
        # Partial sums leave one row for each url before the shuffle.
        sums = _grams(slim, "row", *own).join(F.broadcast(weights), "gram", "left").groupBy("row").agg(F.avg("weight").alias("score"), *(F.first(c).alias(c) for c in own))
    else:
        # Only rows' numbers go with the grams; frequent grams are no hot keys. The rows are written first, as their numbers must be the same twice.
        slim = stored(slim, "urls")
        met = join_hot(_grams(slim, "row"), weights, ["gram"], grams.select("gram", "n"), grams.agg(F.sum("n")).first()[0])
        sums = slim.join(met.groupBy("row").agg(F.avg("weight").alias("score")), "row").select("row", "score", *own)
    scored = stored(sums.drop("row"), "scored")
    step = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) * STEPS)
    bins = scored.filter("says is not null and aside").groupBy(step.alias("step")).agg(F.sum((F.col("says") == "allow").cast("long")).alias("a"), F.sum((F.col("says") == "block").cast("long")).alias("b"))
    # 2 * LIMIT * STEPS + 1 bins at most. Blocking what lies below a step's start: blocked share of what rules block, less that of what they allow.
    below, every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    share = lambda c: F.try_divide(F.coalesce(F.sum(c).over(below), F.lit(0)), F.sum(c).over(every))
    best = bins.select("step", F.round(share("b") - share("a"), 12).alias("gain")).filter("gain is not null").orderBy(F.desc("gain"), "step").first()
    method = F.lit("allow") if best is None else F.when(step < best.step, "block").otherwise("allow")
    score = F.lit(None).cast("double") if best is None else F.col("score")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("says", method).alias("verdict"), score.alias("score"))

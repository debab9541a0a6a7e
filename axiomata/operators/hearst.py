"""Relations stated in texts: two known phrases with a telling expression between them.

Only text near such an expression is looked at: its word runs, with their
places, meet the known phrases in an equality join, so neither the phrases nor
the texts are broadcast. Neighbouring occurrences are found by ``lead`` within
a document; everything after the parse stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stages import spread

# Expressions and what they say of the phrases before and after them.
DOWN, UP, SAME, VERB = "first_narrower", "second_narrower", "same", "after_verb"
EXPRESSIONS = {
    **dict.fromkeys(("is a", "is an", "are a", "is a kind of", "are a kind of", "is a type of", "are a type of", "is a special case of", "are special cases of", "is a particular case of", "is a special type of", "is a subclass of", "are a subclass of"), DOWN),
    **dict.fromkeys(("such as", "including", "like", "for example", "for instance", "generalizes", "generalize", "is a generalization of", "is a natural generalization of", "are generalizations of"), UP),
    **dict.fromkeys(("to", "into"), VERB),
    **dict.fromkeys(("is equivalent to", "are equivalent to", "if and only if", "iff", "is also known as", "is also called", "also known as", "coincides with", "is the same as", "are the same as"), SAME),
}
BARE = ("is a", "is an", "are a")
# Heads that make an object a mere description, and prepositions that put a subject inside a phrase.
DESCRIPTIVE = "function functional functions functionals measure measures map maps mapping mappings operator operators invariant invariants quantity quantities statistic statistics metric metrics norm norms matrix matrices vector vectors sequence sequences series polynomial polynomials distribution distributions parameter parameters coefficient coefficients bound bounds constant constants value values number numbers estimate estimates solution solutions condition conditions property properties feature features description descriptions".split()
PREPOSITIONS = "of with in on for by via under within among between using from over without upon into onto through throughout despite during after before above below near toward towards against along across about to".split()
GLUE, BACK, VERB_BACK, WORDS = 40, 60, 40, 6
_NEAR = re.compile(r"\b(?:" + "|".join(re.escape(e).replace(r"\ ", r"[\W_]+") for e in sorted(EXPRESSIONS, key=len, reverse=True)) + r")\b")
_RUN = re.compile(r"[^\W_](?:[\w'-]*[^\W_])?")


def _occurrences(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, start, stop, phrase, before, after, head, tail) for each word run near an expression."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, original in zip(pdf["d"], pdf["t"], strict=True):
                lower = (original or "").lower()
                if len(lower) != len(original or ""):
                    original = lower  # a letter whose lower case is longer
                spans: dict[tuple[int, int], None] = {}
                for m in _NEAR.finditer(lower):
                    low = max(0, m.start() - 140)
                    words = list(_RUN.finditer(lower, low, min(len(lower), m.end() + 140)))
                    for i in range(len(words)):
                        for j in range(i, min(len(words), i + WORDS)):
                            if j > i and lower[words[j - 1].end() : words[j].start()] != " ":
                                break
                            spans[words[i].start(), words[j].end()] = None
                # the ends of sentences around a word serve all runs that begin or end with it
                first = {a: max(original.rfind(c, 0, a) for c in ".!?") + 1 for a in {a for a, _ in spans}}
                last = {b: min((k for k in (original.find(c, b) for c in ".!?") if k >= 0), default=len(original) - 1) + 1 for b in {b for _, b in spans}}
                for a, b in spans:
                    rows.append((d, a, b, lower[a:b], lower[max(0, a - BACK) : a], original[b : b + GLUE], original[first[a] : b], original[a : last[b]]))
            yield pd.DataFrame(rows, columns=["doc", "start", "stop", "phrase", "before", "after", "head", "tail"])

    return spread(docs.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t"))).mapInPandas(run, "doc string, start long, stop long, phrase string, before string, after string, head string, tail string")


def hits(docs: DataFrame, doc: str, text: str, phrases: DataFrame) -> DataFrame:
    """W-04, T-15..T-20: (subject, object, kind, sentence, doc) of phrase pairs in the column ``phrase`` of ``phrases``.

    Occurrences that overlap are no pair. Of occurrences that start together
    the shorter comes first.
    """
    known = phrases.select("phrase").distinct()
    found = _occurrences(docs, doc, text).join(known, "phrase")
    w = Window.partitionBy("doc").orderBy("start", "stop")
    paired = found.withColumns({"next": F.lead("phrase").over(w), "at": F.lead("start").over(w), "rest": F.lead("tail").over(w)}).filter(F.col("next").isNotNull() & (F.col("at") >= F.col("stop")) & (F.col("at") - F.col("stop") <= GLUE))
    between = F.substring("after", F.lit(1), (F.col("at") - F.col("stop")).cast("int"))
    exact = T.glue(between)
    effect = F.create_map(*[F.lit(x) for pair in EXPRESSIONS.items() for x in pair])
    marked = paired.withColumn("g", exact).withColumn("g", F.when(effect[F.col("g")].isNotNull(), F.col("g")).otherwise(T.strip_article(F.col("g")))).withColumn("effect", effect[F.col("g")]).filter("effect is not null")
    clause = F.substring_index("before", ",", -1)
    inside = clause.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(PREPOSITIONS)})(?![\p{{L}}\p{{N}}])")
    described = F.col("g").isin(*BARE) & F.substring_index("next", " ", -1).isin(*DESCRIPTIVE)
    verb = F.right("before", F.lit(VERB_BACK)).rlike(r"generali[sz](?:e|es|ing|ed) ")
    good = F.when(F.col("effect") == DOWN, ~inside & ~described).when(F.col("effect") == VERB, verb).otherwise(F.lit(True))
    turned = F.col("effect") == UP
    return marked.filter(good).select(
        F.when(turned, F.col("next")).otherwise(F.col("phrase")).alias("subject"),
        F.when(turned, F.col("phrase")).otherwise(F.col("next")).alias("object"),
        F.when(F.col("effect") == SAME, "equivalent_to").otherwise("specialization_of").alias("kind"),
        F.trim(F.concat("head", between, "rest")).alias("sentence"),
        "doc",
    )

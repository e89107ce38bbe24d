"""Noun lemmas by suffix detachment against a lexicon table and a table of exceptions.

A word that is an exception has its listed forms. Else suffixes are detached, again and again until a form is in the lexicon; the word itself counts
as a form of the first round. The shortest form in the lexicon is the lemma, of equally short ones the first found; a word
without one stands for itself. Only distinct words meet the lexicon, and what goes back to the texts is the words that change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X
from ..sources import files

#: Changed words that are broadcast to the texts; more are joined by a shuffle.
BROADCAST = 500_000


def forms(word: Column) -> Column:
    """(round, form) of all forms that detaching suffixes gives, in the order found; the word itself first."""
    detach = lambda f: F.array_compact(F.array(*[F.when(f.endswith(old), F.concat(f.substr(F.lit(1), F.length(f) - len(old)), F.lit(new))) for old, new in fixed.NOUN_SUFFIXES]))
    named = lambda n, xs: F.transform(xs, lambda x: F.struct(n.alias("round"), x.alias("form")))
    start = F.struct(F.array(word).alias("now"), named(F.lit(1), F.array(word)).alias("all"))

    def again(state: Column, n: Column) -> Column:
        found = F.flatten(F.transform(state["now"], detach))
        return F.struct(found.alias("now"), F.concat(state["all"], named(n, found)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), start, again, lambda state: state["all"])


def lemma_table(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(word, lemma) of those distinct ``words`` (word) whose lemma differs, by ``lexicon`` (word) and ``exceptions`` (word, form)."""
    listed = exceptions.where("word is not null").groupBy("word").agg(F.array_sort(F.collect_list("form")).alias("listed"))
    found = words.join(listed, "word", "left")
    own = F.transform(F.concat(F.array("word"), F.col("listed")), lambda x: F.struct(F.lit(1).alias("round"), x.alias("form")))
    tried = found.select("word", F.posexplode(F.when(F.col("listed").isNotNull(), own).otherwise(forms(F.col("word")))).alias("place", "x")).select("word", "place", "x.*")
    there = tried.join(lexicon.select(F.col("word").alias("form")).distinct(), "form", "left_semi")
    best = there.groupBy("word").agg(F.min_by("form", F.struct("round", F.length("form"), "place")).alias("lemma"))
    return best.where("lemma <> word")


def preprocess(docs: DataFrame, lexicon: DataFrame, exceptions: DataFrame, text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with ``words``: the cleaned words of ``text`` but stop words and single letters, as lemmas, joined by spaces.

    A null or empty text gives the empty text; repeated rows are handled each. An empty lexicon leaves all words as they are.
    """
    rows = files.written(docs.select(F.struct("*").alias("doc"), X.kept_words(F.col(text)).alias("kept")), "kept").withColumn("row", F.monotonically_increasing_id())
    seen = rows.select("row", F.explode(F.array_distinct("kept")).alias("word"))
    table = files.written(lemma_table(seen.select("word").distinct(), lexicon, exceptions), "lemmas")
    # A row's words stay in it: what goes back to it is those of its words that change, once each.
    told = seen.join(F.broadcast(table) if table.count() <= broadcast else table, "word")
    changed = told.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("lemmas"))
    joined = F.array_join(F.transform("kept", lambda w: F.coalesce(F.try_element_at("lemmas", w), w)), " ")
    return rows.join(changed, "row", "left").select("doc.*", joined.alias("words"))

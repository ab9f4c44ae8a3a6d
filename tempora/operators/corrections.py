"""Corrections of misheard words by the words around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import clamp, let
from ..functions.text import trimmed_token

# Words that are taken for one another, in order of preference.
CONFUSIONS = {
    "live": ["life"], "hear": ["here"], "there": ["their", "they're"], "their": ["there", "they're"], "to": ["too", "two"], "too": ["to", "two"],
    "peace": ["piece"], "piece": ["peace"], "weather": ["whether"], "whether": ["weather"], "accept": ["except"], "affect": ["effect"],
}
# Parts of speech of those words, and classes of their neighbours.
PARTS = {"noun": ["life", "piece", "peace", "weather", "effect", "here", "there"], "verb": ["live", "hear", "accept", "affect"], "modifier": ["live", "too"]}
FOLLOWERS = {
    "copula": ["is", "was", "has", "looks", "seems", "becomes"], "preposition": ["in", "at", "on", "with", "from", "to", "into", "by", "for"],
    "nominal": ["broadcast", "performance", "show", "stream", "audience", "concert", "music"],
}
LEADERS = {"pronoun": ["i", "you", "we", "they", "he", "she"], "determiner": ["my", "your", "our", "their", "his", "her", "the", "this", "a", "an"]}
# Hundredths that a neighbour of the class adds to the fit of a part of speech.
FRAMES = [
    ("copula", "noun", 45), ("copula", "verb", -40), ("preposition", "verb", 45), ("preposition", "noun", -45), ("nominal", "modifier", 45), ("nominal", "noun", -30),
    ("pronoun", "verb", 45), ("pronoun", "noun", -45), ("determiner", "noun", 40), ("determiner", "verb", -40),
]
# Topics of nearby words, and the hundredths that each such word adds to an option.
TOPICS = {
    "being": ["box", "surprises", "chocolates", "short", "meaning", "journey", "lesson", "experience", "story", "beautiful", "death", "human"],
    "dwelling": ["portugal", "country", "city", "together", "here", "there", "house", "apartment", "town", "place", "alone", "abroad"],
    "stage": ["broadcast", "performance", "show", "stream", "concert", "air", "music", "stage"],
}
AFFINITY = [("life", "being", 45), ("life", "dwelling", -35), ("life", "stage", -30), ("live", "being", -30), ("live", "dwelling", 45), ("live", "stage", 45)]
# Hundredths of two words in a row; any other two have 50.
TRANSITIONS = {
    "life is": 95, "life was": 95, "life has": 95, "live is": 10, "live was": 10, "live has": 10, "i live": 95, "we live": 95, "they live": 95, "you live": 95,
    "i life": 10, "we life": 10, "they life": 10, "you life": 10, "live in": 95, "live at": 95, "live on": 95, "live with": 95, "live together": 95, "life in": 30,
    "live broadcast": 95, "live performance": 95, "live stream": 95, "live show": 95, "life broadcast": 20, "life performance": 20, "my life": 95, "your life": 95,
    "our life": 95, "my live": 10, "your live": 10,
}
# Weights of sound, grammar, topic, phrase and prior; consonants that sound alike have one digit.
SOUND, GRAMMAR, TOPIC, PHRASE, PRIOR = 0.20, 0.30, 0.25, 0.15, 0.10
CONSONANTS, SOUNDS = "fvbpmsztdkglrn", "11222334455667"
REACH = 3
# Fixed value: words of a block of context.
BLOCK = 4096


def _literal_map(items: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in items.items() for x in pair))


def sound_likeness(a: Column, b: Column) -> Column:
    """Half edit likeness, half the share of places with consonants on both sides where these sound alike (edit likeness if there are none)."""
    sounds = lambda w: F.translate(F.regexp_replace(w, f"[^{CONSONANTS}]", "-"), CONSONANTS, SOUNDS)
    longest = F.greatest(F.length(a), F.length(b))
    edit = F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    # the words are turned into sounds once, not for each place
    paired = let(F.struct(sounds(a).alias("a"), sounds(b).alias("b")), lambda w: F.transform(places, lambda i: F.struct(F.substr(w["a"], i, F.lit(1)).alias("a"), F.substr(w["b"], i, F.lit(1)).alias("b"))))
    share = lambda both: F.when(F.size(both) == 0, edit).otherwise(F.size(F.filter(both, lambda x: x["a"] == x["b"])) / F.size(both))
    alike = let(F.filter(paired, lambda x: (x["a"] != "-") & (x["a"] != "") & (x["b"] != "-") & (x["b"] != "")), share)
    return F.when(a == b, 1.0).otherwise(0.5 * alike + 0.5 * edit)


def _fit(option: Column, own: bool, near: dict[str, Column]) -> Column:
    """The weighted score of an option for a word with the context ``near`` (token, left, right and a count for each topic)."""
    some = lambda c, points: F.when(F.coalesce(c, F.lit(False)), points).otherwise(0)
    neighbour = {**{k: near["right"].isin(v) for k, v in FOLLOWERS.items()}, **{k: near["left"].isin(v) for k, v in LEADERS.items()}}
    grammar = reduce(lambda a, b: a + b, (some(neighbour[k] & option.isin(PARTS[part]), points) for k, part, points in FRAMES))
    topic = reduce(lambda a, b: a + b, (F.when(option == word, points * near[name]).otherwise(0) for word, name, points in AFFINITY))
    bounded = lambda points: clamp((50 + points) / 100.0, 0.05, 1.0)
    after = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_element_at(_literal_map(TRANSITIONS), F.concat_ws(" ", a, b)), F.lit(50)))
    sides = F.array_compact(F.array(after(near["left"], option), after(option, near["right"])))
    phrase = let(sides, lambda x: F.when(F.size(x) == 0, 0.5).otherwise(F.aggregate(x, F.lit(0), lambda y, z: y + z) / F.size(x) / 100.0))
    prior = lambda sound: F.lit(0.70) if own else clamp(0.30 * sound, 0.05, 0.95)
    total = lambda sound: SOUND * sound + GRAMMAR * bounded(grammar) + TOPIC * bounded(topic) + PHRASE * phrase + PRIOR * prior(sound)
    return total(F.lit(1.0)) if own else let(sound_likeness(option, near["token"]), total)


def semantic_corrections(words: DataFrame, confusions: dict[str, list[str]] | None = None, least: float = 0.85, margin: float = 0.20) -> DataFrame:
    """The words with ``text`` corrected, and raw_text, confidence and rule (null where nothing changed). Rows, order and times stay.

    A word that has options (``confusions``) takes the best one that scores ``least`` and beats the word itself by ``margin``; ties go to the
    first listed. Capitals and trailing punctuation are kept. word_idx numbers a source's words without holes: the context is the words within
    REACH numbers, seen by windows over blocks of BLOCK numbers that take REACH words of their neighbours along, so a long source is spread over
    many keys, and words that lie by source are not shuffled. A null text is left alone.
    """
    confusions = confusions if confusions is not None else CONFUSIONS
    own, context = F.col("_own"), {"token": F.col("_own"), "left": F.col("_left"), "right": F.col("_right")} | {name: F.col(f"_{name}") for name in TOPICS}
    block = lambda k: F.floor((F.col("word_idx") + k) / BLOCK)
    listed = words.withColumn("_own", trimmed_token(F.col("text"))).withColumn("_block", F.explode(F.sequence(block(-REACH), block(REACH))))
    order = Window.partitionBy("source_id", "_block").orderBy("word_idx")
    at = lambda k: F.max("_own").over(order.rangeBetween(k, k))
    of = {name: F.coalesce(own.isin(topic), F.lit(False)).cast("int") for name, topic in TOPICS.items()}
    topics = {f"_{name}": F.sum(count).over(order.rangeBetween(-REACH, REACH)) - count for name, count in of.items()}
    near = listed.withColumns({"_left": at(-1), "_right": at(1)} | topics).filter(F.col("_block") == block(0))
    options = F.try_element_at(F.create_map(*(x for raw, o in confusions.items() for x in (F.lit(raw), F.array(*map(F.lit, o))))), own)
    scored = F.transform(options, lambda o, i: F.struct(_fit(o, False, context).alias("score"), (-i).alias("first"), o.alias("option")))
    passed = let(_fit(own, True, context), lambda raw: F.array_max(F.filter(scored, lambda s: (s["score"] >= least) & (s["score"] - raw >= margin))))
    found = near.withColumn("_best", F.when(own.isin(list(confusions)), passed))
    joined = found.withColumns({"_option": F.col("_best.option"), "confidence": F.col("_best.score"), "raw_text": F.when(F.col("_best").isNotNull(), F.col("text"))})
    rule = F.when(F.col("_best").isNotNull(), F.concat_ws("_", F.lit("contextual_semantic"), own, F.lit("to"), "_option"))
    option = F.when(F.col("text").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("_option", 1, 1)), F.expr("substring(_option, 2)"))).otherwise(F.col("_option"))
    text = F.when(F.col("_option").isNull(), F.col("text")).otherwise(F.concat(option, F.regexp_extract("text", r"(\p{Punct}*)$", 1)))
    return joined.withColumns({"text": text, "rule": rule}).select(*words.columns, "raw_text", "confidence", "rule")

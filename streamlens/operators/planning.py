"""Plans of search queries as Columns over a table of query texts: filters, provable clauses, concepts, word families, aliases.

A plan is made for every row of a DataFrame of queries (a log, or a single typed one) with built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamlens.functions import times
from streamlens.functions.strings import clean, tokens

#: Words that carry no meaning in a query.
STOP = ["a", "an", "and", "are", "at", "because", "every", "find", "for", "from", "i", "in", "is", "it", "me", "my", "of", "on", "show", "that", "the", "things", "this", "time", "to", "was", "when", "where", "with"]
GENERIC = ["highlight", "highlights", "moment", "moments", "reaction", "reactions", "aka", "made", "some", "somehow"]
GLUE = ["after", "before", "during", "followed", "happened", "then", "while"]
#: Fixed values: (pattern, filter, value) in the order in which they are looked for.
FILTERS = [
    (r"\b(?:clips?\s+)?(?:i\s+)?kept\b", "decision", "kept"),
    (r"\b(?:clips?\s+)?(?:i\s+)?passed\b", "decision", "passed"),
    (r"\bmaybe\s+clips?\b", "decision", "maybe"),
    (r"\b(?:unreviewed|not\s+reviewed)\b", "decision", "unreviewed"),
    (r"\b(?:unexported|(?:not|never)\s+exported)\b", "exported", "not_exported"),
    (r"\b(?:already\s+)?exported\b", "exported", "exported"),
    (r"\b(?:marked|remembered)(?:\s+(?:live|moments?|things?))?\b", "origin", "creator_marker"),
    (r"\bremember\s+button\b", "origin", "creator_marker"),
    (r"\b(?:saved\s+)?clips?\b", "kind", "clip"),
    (r"\b(?:best|top|strongest)\b", "sort", "best"),
    (r"\blast\s+month\b", "month", "last"),
    (r"\bthis\s+month\b", "month", "this"),
]
#: Clauses that evidence can prove, with the patterns that ask for them.
CLAUSES = {
    "creator_reaction": [r"\b(?:scream(?:ed|ing|s)?|yell(?:ed|ing|s)?|shout(?:ed|ing|s)?)\b", r"\b(?:strong|big|facecam|creator|streamer)\s+reaction\b", r"\b(?:startl(?:e|ed|ing)|jumpscare(?:d)?)\b"],
    "death": [r"\b(?:die|dies|died|dying|death|dead)\b", r"\b(?:defeat|defeated|game\s+over|round\s+lost)\b"],
    "elimination": [r"\b(?:eliminate|eliminated|elimination|eliminations)\b", r"\b(?:kill|kills|killed|killing|headshot|headshots|knock|knocked)\b"],
    "victory": [r"\b(?:victory(?:\s+royale)?|win|wins|won|winning|round\s+won)\b"],
    "boss": [r"\bboss(?:\s+(?:fight|battle|encounter))?\b"],
    "chat_excitement": [r"\bchat\s+(?:went|goes|was|got)\s+(?:crazy|wild)\b", r"\b(?:everyone|everybody)\s+went\s+(?:crazy|wild)\b", r"\b(?:chat|emote|viewer)\s+spam(?:med|ming)?\b", r"\bchat\s+burst\b", r"\bchat\b"],
}
#: What proves a clause that names an event.
PROOFS = {
    "death": ["death", "dead", "defeat", "defeated", "you died", "game over", "round lost"],
    "elimination": ["elimination", "eliminated", "headshot", "knock", "knocked"],
    "victory": ["victory", "victory royale", "win", "winner", "won", "round won", "terminal win"],
    "boss": ["boss", "boss fight", "boss battle", "boss encounter"],
}
#: Inflections that stand for each other.
FAMILIES = [["snipe", "snipes", "sniped", "sniping", "sniper", "snipers"], ["headshot", "headshots"], ["noscope", "noscopes"], ["max", "maxed", "maxing", "maxxing", "maxxed"]]
#: Triggers in a query, and the words of which a memory must have one.
CONCEPTS = [
    (["aura maxxing", "aura maxing", "aura farming", "aura farm"], ["aura"]),
    (["funny", "hilarious", "joke", "laugh", "comedy"], ["funny", "laughter", "joke", "comedy", "laughter_burst"]),
    (["clutch", "escape", "survive", "barely", "close call", "comeback"], ["clutch", "escape", "survived", "survival", "comeback", "close_call"]),
    (["scare", "scary", "terrified", "horror", "monster", "jumpscare"], ["scare", "scared", "horror", "scream", "jumpscare", "monster"]),
    (["rage", "angry", "mad", "frustrated", "frustration"], ["rage", "angry", "frustration", "shouting", "voice_spike"]),
    (["story", "storytime", "anecdote", "remember when"], ["story", "storytelling", "anecdote", "conversation"]),
    (["reaction", "react", "facecam", "expression"], ["reaction", "facecam_reaction", "voice_reaction", "expression"]),
    (["friend", "friends", "collab", "together", "multiplayer"], ["friend", "friends", "collab", "multiplayer", "party"]),
    (["wholesome", "heartwarming", "sweet", "kind"], ["wholesome", "heartwarming", "sweet", "kind"]),
    (["fail", "failed", "mistake", "disaster", "died", "death"], ["fail", "failure", "mistake", "disaster", "death"]),
    (["excited", "hype", "celebrate", "celebration", "victory"], ["excited", "hype", "celebration", "victory", "cheering"]),
    (["fight", "battle", "combat", "boss"], ["fight", "battle", "combat", "boss", "gameplay"]),
    (["crazy", "insane", "wild", "unbelievable", "unreal", "amazing", "epic"], ["crazy", "insane", "wild", "unbelievable", "unreal", "amazing", "epic", "hype", "reaction", "voice_reaction", "laughter_burst", "clutch"]),
    (["snipe", "snipes", "sniped", "sniping", "sniper", "snipers", "headshot", "headshots", "noscope", "noscopes", "no scope", "long shot", "long-range shot", "precision shot", "one tap"], ["snipe", "sniper", "sniped", "sniping", "headshot", "noscope", "no scope", "long shot", "precision shot", "one tap"]),
]


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def plan_filters(queries: DataFrame, text: str, today: Column, given: dict[str, str] | None = None) -> DataFrame:
    """queries with kind, decision, exported, origin, sort, month, date_from, date_to and rest (the words left over).

    given: filters and dates (yyyy-MM-dd) set beside the text; they win over the text's, whose words are taken out all the same. Of several months named the first rule's counts, and only its words go.
    """
    names = ["kind", "decision", "exported", "origin", "sort", "month"]
    given = given or {}
    df = queries.withColumn("rest", clean(F.col(text))).withColumns({n: F.lit(given.get(n)).cast("string") for n in names})
    for pattern, name, value in FILTERS:
        found = F.col("rest").rlike("(?i)" + pattern)
        found = found & F.col("month").isNull() if name == "month" else found
        df = df.withColumns({name: F.when(found, F.coalesce(name, F.lit(value))).otherwise(F.col(name)), "rest": F.when(found, F.regexp_replace("rest", "(?i)" + pattern, " ")).otherwise(F.col("rest"))})
    last, this = times.month_bounds(today, -1), times.month_bounds(today, 0)
    bound = lambda k: F.when(F.col("month") == "last", last[k]).when(F.col("month") == "this", this[k])
    dates = {n: F.coalesce(F.lit(given.get(n)).cast("date"), bound(k)) for k, n in enumerate(("date_from", "date_to"))}
    return df.withColumns({"rest": clean(F.col("rest")), **dates})


def plan_clauses(queries: DataFrame, text: str, marker: Column) -> DataFrame:
    """queries with clauses (empty unless two or more can be asked for together) and residual (other words that carry meaning)."""
    df = queries.withColumn("residual", clean(F.col(text))).withColumn("clauses", F.array().cast("array<string>"))
    for name, patterns in CLAUSES.items():
        either = "(?i)" + "|".join(patterns)
        df = df.withColumns({"clauses": F.when(F.col("residual").rlike(either), F.concat("clauses", F.array(F.lit(name)))).otherwise(F.col("clauses")), "residual": reduce(lambda c, p: F.regexp_replace(c, "(?i)" + p, " "), patterns, F.col("residual"))})
    df = df.withColumn("clauses", F.when(marker, F.concat("clauses", F.array(F.lit("creator_marker")))).otherwise(F.col("clauses")))
    together = F.size("clauses") >= 2
    words = F.filter(tokens(F.col("residual")), lambda w: ~w.isin(STOP + GENERIC + GLUE))
    return df.withColumns({"residual": F.when(together, F.array_join(words, " ")).otherwise(""), "clauses": F.when(together, F.col("clauses")).otherwise(F.array().cast("array<string>"))})


def token_groups(text: Column) -> Column:
    """Per meaningful word of a query the prefixes of which a memory must have one: the word's family, or itself."""
    words = F.filter(tokens(text), lambda w: ~w.isin(STOP))

    def group(w: Column) -> Column:
        out = F.when(w.isin(FAMILIES[0]), _texts(sorted(FAMILIES[0])))
        for f in FAMILIES[1:]:
            out = out.when(w.isin(f), _texts(sorted(f)))
        return out.otherwise(F.array(w))

    return F.transform(words, group)


def _begins(triggers: list[str]):
    """Whether a word is a trigger, or begins with one of four letters or more."""
    return lambda w: reduce(lambda a, b: a | b, [F.startswith(w, F.lit(t)) if len(t) >= 4 else w == t for t in triggers], F.lit(False))


def concept_groups(text: Column) -> Column:
    """The word groups of the concepts that a query touches, in order; a memory must have a word of every group."""
    raw, words = F.lower(clean(text)), tokens(clean(text))
    found = []
    for triggers, concept in CONCEPTS:
        hit = F.exists(words, _begins([t for t in triggers if " " not in t]))
        for p in [t for t in triggers if " " in t]:
            hit = hit | F.contains(raw, F.lit(p))
        found.append(F.when(hit, _texts(sorted(concept))))
    return F.filter(F.array(*found), lambda g: g.isNotNull())


def expand_aliases(queries: DataFrame, id_: str, text: str, aliases: DataFrame) -> DataFrame:
    """queries with rest (the text without the names found) and families: canonical names found, in the order in which they are looked for.

    aliases: canonical and alias. A family's longest name that stands in the text as whole words counts; longer names are looked for first. Names meet
    texts by their first word, so only names that may stand in a text are tried on it.
    """
    names = aliases.select("canonical", F.explode(F.array(clean(F.col("alias")), clean(F.col("canonical")))).alias("name")).where("name <> ''").distinct()
    quoted = F.regexp_replace("name", r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    names = names.withColumn("pattern", F.concat(F.lit(r"(?i)(?<!\w)"), quoted, F.lit(r"(?!\w)"))).withColumn("first", F.try_element_at(tokens(F.col("name")), F.lit(1)))
    words = queries.select(F.col(id_).alias("__q"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("first"))
    tried = words.join(names, "first").groupBy("__q").agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), "canonical", "name", "pattern"))).alias("__names"))
    start = F.struct(F.col("__raw").alias("rest"), F.array().cast("array<string>").alias("families"))

    def step(acc: Column, x: Column) -> Column:
        fresh = ~F.array_contains(acc["families"], x["canonical"]) & F.rlike(acc["rest"], x["pattern"])
        return F.when(fresh, F.struct(F.regexp_replace(acc["rest"], x["pattern"], F.lit(" ")).alias("rest"), F.array_append(acc["families"], x["canonical"]).alias("families"))).otherwise(acc)

    out = queries.join(tried, F.col(id_) == F.col("__q"), "left").withColumn("__raw", clean(F.col(text)))
    folded = F.aggregate(F.coalesce("__names", F.array().cast(tried.schema["__names"].dataType)), start, step)
    return out.withColumn("__f", folded).select(*queries.columns, clean(F.col("__f.rest")).alias("rest"), F.col("__f.families").alias("families"))


def _first_match(values: Column, words: list[str]) -> Column:
    pattern = r"(?<!\w)(" + "|".join(words) + r")(?!\w)"
    plain = lambda v: F.lower(F.translate(v, "_-", "  "))
    return F.try_element_at(F.filter(values, lambda v: plain(v).rlike(pattern)), F.lit(1))


def proof(clause: str) -> Column:
    """source and detail of what proves a clause for a row with reactions, gameplay_events, visual_texts, ocr_phrases (arrays), chat_messages,
    chat_emotes and marked; null when nothing does. Events go before descriptions, these before text on the screen."""
    none = F.lit(None).cast("struct<source:string,detail:string>")
    said = lambda source, detail: F.struct(F.lit(source).alias("source"), detail.alias("detail"))
    if clause == "creator_reaction":
        seen = F.transform("reactions", lambda v: F.lower(F.replace(clean(v), F.lit("_"), F.lit(" "))))
        partners = ["voice reaction", "streamer reaction", "facecam reaction", "reaction burst"]
        partner = F.coalesce(*[F.when(F.array_contains(seen, p), F.lit(p)) for p in partners])
        spike = F.array_contains(seen, "audio spike") & partner.isNotNull()
        return F.when(F.array_contains(seen, "strong startle"), said("reaction_signal", F.lit("Strong startle"))).when(spike, said("reaction_signal", F.concat(F.initcap(partner), F.lit(" + audio spike")))).otherwise(none)
    if clause == "chat_excitement":
        n, e = F.coalesce("chat_messages", F.lit(0)), F.coalesce("chat_emotes", F.lit(0))
        text = F.concat(n.cast("string"), F.lit(" chat messages"), F.when(e > 0, F.concat(F.lit(" + "), e.cast("string"), F.lit(" emotes"))).otherwise(""))
        return F.when(n > 0, said("chat_activity", text)).otherwise(none)
    if clause == "creator_marker":
        return F.when(F.coalesce("marked", F.lit(False)), said("creator_marker", F.lit("Remember marker"))).otherwise(none)
    sources = {"gameplay_events": "gameplay_event", "visual_texts": "visual_description", "ocr_phrases": "on_screen_text"}
    hits = [(said(s, _first_match(F.col(c), PROOFS[clause])), _first_match(F.col(c), PROOFS[clause])) for c, s in sources.items()]
    return F.coalesce(*[F.when(m.isNotNull(), h) for h, m in hits])


def proved(df: DataFrame, clauses: list[str]) -> DataFrame:
    """The rows of df for which every clause is proved, with proofs: clause, source and detail in order."""
    df = df.withColumn("proofs", F.array(*[F.struct(F.lit(c).alias("clause"), proof(c)["source"].alias("source"), proof(c)["detail"].alias("detail")) for c in clauses]))
    return df.where(F.forall("proofs", lambda p: p["source"].isNotNull()))

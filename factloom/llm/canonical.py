"""Free-entered values mapped to the entries of a reference list, the rest reported as other.

A pigeonhole join finds the entry meant: a reference string of length L that may differ by k edits is cut into k + 1 segments,
of which an edited copy still holds one unchanged, shifted by at most k. References' segments and inputs' substrings are joined
by equality on (L, segment number, substring), pairs are verified with levenshtein, and inputs without a verified pair are found
by an anti-join. All of it is SQL; no pair of input and reference is formed that shares no segment.

References are the entries, the phrases of their glosses (cut at commas and at "or", without words that say nothing) and a thesaurus
of other ways to say them. Their index is broadcast if it has no more than INDEX rows. Inputs are reduced to distinct strings first.

Null and blank inputs, and inputs that are an entry verbatim, are no cases; inputs without letters or digits, and ones longer
than the longest reference with its edits, come out as other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Other ways to say an entry of the vocabulary.
SYNONYMS = {
    "name": ["is called", "goes by", "full name", "is known as"],
    "age": ["years old", "how old", "age in years", "years of age"],
    "occupation": ["line of work", "profession", "trade", "does for a living", "vocation"],
    "employer": ["works for", "works at", "company they work for", "place of employment", "current employing organisation", "employed by", "is employed at"],
    "job_title": ["position at work", "role title at work", "job position", "professional title"],
    "lives_in": ["living in", "resides in", "city of residence", "current residence", "is resident of", "makes home in", "place of residence"],
    "hometown": ["home town originally", "grew up in", "raised in", "town of origin", "comes from", "native town", "childhood town"],
    "birthday": ["dob", "birth date", "date of birth", "born on", "day of birth"],
    "family_relation": ["family member", "parent of", "is sibling of", "relative", "spouse", "is married to", "is related to", "next of kin"],
    "pet": ["animal at home", "household pet", "keeps animal", "pet animal"],
    "health_condition": ["medical condition", "illness", "suffers from", "diagnosed with", "ailment", "health problem", "medical issue"],
    "education": ["schooling", "degree", "studied at", "course of study", "academic background", "went to school at", "qualification"],
    "skill": ["able to do well", "is good at", "talented at", "proficient in", "ability"],
    "language": ["speaks", "mother tongue", "spoken tongue", "native language", "speaks fluently"],
    "likes": ["is fond of", "enjoys", "loves", "is keen on", "is a fan of"],
    "dislikes": ["hates", "cannot stand", "avoids", "is averse to", "detests"],
    "prefers": ["favours", "would rather have", "has preference for", "would rather"],
    "allergic_to": ["has allergy", "allergy", "food allergies", "is allergic", "intolerant of"],
    "dietary_restriction": ["diet rule", "does not eat", "food restriction", "dietary requirement", "special diet"],
    "goal": ["wants to reach", "aims for", "objective", "ambition", "strives for"],
    "plan": ["intends to", "intention", "is planning to", "future plan"],
    "budget": ["spending limit", "money set aside", "spending allowance", "can spend"],
    "owns": ["possesses", "has in possession", "belongs to subject", "is the owner of", "ownership of"],
    "uses": ["utilises", "makes use of", "relies on", "is a user of"],
    "subscribes_to": ["paid subscription", "has subscription", "subscriber of", "membership of", "is subscribed to"],
    "quantity": ["how many", "count of", "number of items", "total number of", "amount of"],
    "purchased": ["bought", "has bought", "purchase made", "acquired by purchase", "paid for"],
    "visited": ["travelled to", "went on trip to", "trip destination", "has been to", "paid a visit to"],
    "attended": ["was present at", "took part in event", "went to event", "participated in", "was at event"],
    "scheduled": ["booked for date", "has appointment", "appointment on", "is scheduled for", "date arranged"],
    "started": ["began", "has begun", "took up", "has started", "commenced"],
    "stopped": ["gave up", "quit", "no longer does", "ceased", "discontinued"],
    "completed": ["finished", "has finished", "brought to an end", "accomplished"],
    "experienced": ["went through", "happened to them", "underwent", "lived through"],
    "email": ["electronic mail", "e mail addr", "mail address electronic", "email address"],
    "phone": ["tel no", "mobile number", "telephone", "phone number", "cell number"],
    "address": ["street and number", "home addr", "postal address", "mailing address", "where to send post"],
    "social_account": ["profile handle", "network profile", "social media account", "user handle"],
}

# Words of a gloss that say nothing about the entry.
GLOSS_GLUE = "something,someone,the subject,subject,such as,in general,kept,that is,that,which,now,a,an,the,this"
#: Letters from which a phrase of a gloss counts; shorter ones are common words.
GLOSS_LEAST = 10
#: Segments of references that are broadcast.
INDEX = 100_000

#: Edits allowed for a reference of each length: (longest length, edits).
EDITS = [(3, 0), (5, 1), (8, 2), (9, 3), (10**6, 4)]
MOST = EDITS[-1][1]


def _edits(length: str) -> str:
    return "CASE " + " ".join(f"WHEN {length} <= {upto} THEN {k}" for upto, k in EDITS) + " END"


def references(canon: DataFrame) -> DataFrame:
    """predicate, ref, len, k, plain (2: the entry itself, 1: of the thesaurus, 0: of its gloss) of each reference string.

    A phrase that the glosses of several entries share tells nothing, nor one that is another entry's other way to say it.
    """
    spark = canon.sparkSession
    thesaurus = spark.createDataFrame([(p, s) for p, all_ in SYNONYMS.items() for s in all_], "predicate string, said string")
    entries = canon.where("predicate is not null and predicate <> 'other'").select("predicate", "gloss")
    own = entries.select("predicate").distinct()
    cut = "',| or | and |;'"
    bare = f"trim(regexp_replace(lower(coalesce(gloss, '')), '\\\\b({GLOSS_GLUE.replace(',', '|')})\\\\b', ' '))"
    phrases = entries.selectExpr("predicate", f"explode(array_union(split(lower(coalesce(gloss, '')), {cut}), split({bare}, {cut}))) AS said")
    both = own.selectExpr("predicate", "predicate AS said", "2 AS plain").unionByName(thesaurus.join(own, "predicate", "left_semi").selectExpr("predicate", "said", "1 AS plain")).unionByName(phrases.selectExpr("predicate", "said", "0 AS plain"))
    refs = both.selectExpr("predicate", r"regexp_replace(lower(said), '[^\\p{L}\\p{N}]+', '') AS ref", "plain").where(f"ref <> '' and (plain > 0 or length(ref) >= {GLOSS_LEAST})")
    refs = refs.groupBy("ref").agg(F.max("plain").alias("plain"), F.max_by("predicate", "plain").alias("predicate"), F.countDistinct("predicate").alias("n")).where("plain > 0 or n = 1")
    return refs.selectExpr("predicate", "ref", "plain", "length(ref) AS len", f"{_edits('length(ref)')} AS k")


def spellings(values: DataFrame) -> DataFrame:
    """value, form, cost: the forms under which a value is looked up. Forms that leave out a leading word or a plural cost more."""
    v = values.selectExpr("value", r"lower(regexp_replace(value, '(\\p{Ll}|\\p{N})(\\p{Lu})', '$1 $2')) AS w")
    v = v.selectExpr("value", r"regexp_replace(w, '[^\\p{L}\\p{N}]+', ' ') AS w").selectExpr("value", "trim(w) AS w")
    v = v.selectExpr("value", "replace(w, ' ', '') AS whole", "replace(regexp_replace(w, '^(has|is|the|user|a|an) ', ''), ' ', '') AS bare")
    forms = "array_distinct(array(struct(whole AS form, 0 AS cost), struct(regexp_replace(whole, 's$', '') AS form, 1 AS cost), struct(bare AS form, 2 AS cost), struct(regexp_replace(bare, 's$', '') AS form, 3 AS cost)))"
    return v.select("value", F.expr(f"inline({forms})")).where("form <> ''").groupBy("value", "form").agg(F.min("cost").alias("cost"))


def matched(values: DataFrame, canon: DataFrame) -> DataFrame:
    """value, predicate, edits of each distinct value that means an entry."""
    refs = references(canon)
    index = refs.selectExpr("predicate", "ref", "len", "k", "plain", "explode(sequence(0, k)) AS i").selectExpr("*", "substring(ref, i * len div (k + 1) + 1, (i + 1) * len div (k + 1) - i * len div (k + 1)) AS seg")
    n = F.length("form")
    longest = refs.agg(F.coalesce(F.max(F.col("len") + F.col("k")), F.lit(0)).alias("longest"))  # one row
    forms = spellings(values).crossJoin(F.broadcast(longest)).where(n <= F.col("longest")).drop("longest")
    p = forms.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(1), n - MOST), n + MOST))).withColumn("k", F.expr(_edits("len"))).where("abs(length(form) - len) <= k")
    p = p.withColumn("i", F.expr("explode(sequence(0, k))")).withColumn("at", F.expr("explode(sequence(greatest(0, i * len div (k + 1) - k), i * len div (k + 1) + k))"))
    p = p.selectExpr("value", "form", "cost", "len", "i", "substring(form, at + 1, (i + 1) * len div (k + 1) - i * len div (k + 1)) AS seg").distinct()
    near = F.broadcast(index) if canon.limit(INDEX // 40 + 1).count() <= INDEX // 40 else index  # an entry has fewer than 40 segments
    pairs = p.join(near, ["len", "i", "seg"]).select("value", "form", "cost", "predicate", "ref", "k", "plain").distinct()
    good = pairs.withColumn("edits", F.levenshtein("form", "ref")).where("edits <= k")
    # Fewest edits first, then the fuller form, then entries before synonyms, then the longer reference, then the name.
    best = good.groupBy("value").agg(F.min(F.struct("edits", "cost", (-F.col("plain")).alias("plain"), (-F.length("ref")).alias("len"), "predicate")).alias("b"))
    return best.select("value", "b.predicate", "b.edits")


def canonical(facts: DataFrame, canon: DataFrame) -> DataFrame:
    """extract_id, predicate for each row whose predicate is neither null nor blank nor an entry verbatim."""
    entries = canon.select("predicate").distinct()
    free = facts.select("extract_id", F.col("predicate").alias("value")).where(r"value rlike '[^\\s\\p{Z}]'").join(entries.withColumnRenamed("predicate", "value"), "value", "left_anti")
    values = free.select("value").distinct()
    found = matched(values, canon).select("value", "predicate")
    rest = values.join(found, "value", "left_anti").select("value", F.lit("other").alias("predicate"))
    return free.join(found.unionByName(rest), "value").select("extract_id", "predicate")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark.read.parquet(f"{d}/extracted_facts.parquet"), spark.read.parquet(f"{d}/canon_predicates.parquet"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The distinct values without an entry, with how many rows have each."""
    facts, canon = spark.read.parquet(f"{d}/extracted_facts.parquet"), spark.read.parquet(f"{d}/canon_predicates.parquet")
    c = canonical(facts, canon).where("predicate = 'other'").select("extract_id")
    return facts.join(c, "extract_id", "left_semi").groupBy(F.col("predicate").alias("value")).agg(F.count("*").alias("n"))


def _oracle() -> str:
    """The mapping by brute force: every distinct value against every reference."""
    said = ", ".join(f"('{p}', '{s}')" for p, all_ in SYNONYMS.items() for s in all_)
    return f"""
said(predicate, said) AS (VALUES {said}),
entries AS (SELECT predicate, gloss FROM canon_predicates WHERE predicate IS NOT NULL AND predicate <> 'other'),
phrases AS (SELECT predicate, unnest(list_concat(regexp_split_to_array(lower(coalesce(gloss, '')), ',| or | and |;'), regexp_split_to_array(trim(regexp_replace(lower(coalesce(gloss, '')), '\\b({GLOSS_GLUE.replace(",", "|")})\\b', ' ', 'g')), ',| or | and |;'))) AS said FROM entries),
every AS (SELECT predicate, regexp_replace(lower(said), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS ref, plain FROM (SELECT DISTINCT predicate, predicate AS said, 2 AS plain FROM entries
  UNION ALL SELECT predicate, said, 1 FROM said WHERE predicate IN (SELECT predicate FROM entries) UNION ALL SELECT predicate, said, 0 FROM phrases)),
refs AS (SELECT ref, max(plain) AS plain, arg_max(predicate, plain) AS predicate FROM every WHERE ref <> '' AND (plain > 0 OR length(ref) >= {GLOSS_LEAST}) GROUP BY ref HAVING max(plain) > 0 OR count(DISTINCT predicate) = 1),
v AS (SELECT DISTINCT predicate AS value FROM extracted_facts WHERE regexp_matches(predicate, '[^\\s\\p{{Z}}]') AND predicate NOT IN (SELECT predicate FROM canon_predicates)),
w AS (SELECT value, trim(regexp_replace(lower(regexp_replace(value, '(\\p{{Ll}}|\\p{{N}})(\\p{{Lu}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM v),
f AS (SELECT value, replace(w, ' ', '') AS whole, replace(regexp_replace(w, '^(has|is|the|user|a|an) ', ''), ' ', '') AS bare FROM w),
forms AS (SELECT value, form, min(cost) AS cost FROM (SELECT value, whole AS form, 0 AS cost FROM f UNION ALL SELECT value, regexp_replace(whole, 's$', ''), 1 FROM f
  UNION ALL SELECT value, bare, 2 FROM f UNION ALL SELECT value, regexp_replace(bare, 's$', ''), 3 FROM f) WHERE form <> '' GROUP BY 1, 2),
good AS (SELECT value, predicate, levenshtein(form, ref) AS edits, cost, plain, length(ref) AS n FROM forms, refs WHERE levenshtein(form, ref) <= {_edits("length(ref)")}),
best AS (SELECT value, predicate FROM good QUALIFY row_number() OVER (PARTITION BY value ORDER BY edits, cost, plain DESC, n DESC, predicate) = 1),
mapped AS (SELECT extract_id, e.predicate AS value, coalesce(best.predicate, 'other') AS predicate FROM extracted_facts e JOIN v ON e.predicate = v.value LEFT JOIN best ON best.value = v.value)
"""


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched}
ORACLE = {"p2_found": f"WITH {_oracle()} SELECT extract_id, predicate FROM mapped", "p2_unmatched": f"WITH {_oracle()} SELECT value, count(*) AS n FROM mapped WHERE predicate = 'other' GROUP BY 1"}

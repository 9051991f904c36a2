"""High-precision rules: DataFrame to DataFrame, each proposes (q_id, p_id, kind).

Records carry what rules need as columns (:func:`prepared`), computed once a
distinct text.  Every rule is an equi-join of groups of records that it cannot tell
apart, cheap column predicates, then an Arrow kernel on what is left, then the
guard that exactly one query claims the candidate.  Rules at an address also take
:func:`gathered` records: those are read to be counted by their texts, and again
only where a text has a single claim.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import kernels as kn
from kinweave.functions import text as t

MIN_STREET = 0.85


def prepared(records: DataFrame, *more: str) -> DataFrame:
    """entity_id, country, name, address, ``more`` columns, key (sorted core words), words (in order), legal, num, street, blank; a text is read once, however many records have it."""
    country = F.col("country") if "country" in records.columns else F.lit("").alias("country")
    r = records.select("entity_id", country, "name", "address", *more, F.coalesce("name", F.lit("")).alias("_name"), F.coalesce("address", F.lit("")).alias("_address"))
    split = r.select("_name").distinct().select("_name", t.split_core("_name").alias("_split"))
    names = split.select(
        "_name", t.split_key(F.col("_split")).alias("key"), t.split_key(F.col("_split"), ordered=True).alias("words"),
        F.coalesce(F.col("_split")["legal"], F.array().cast("array<string>")).alias("legal"),
    )
    places = r.select("_address").distinct().select(
        "_address", kn.street_number_udf("_address").alias("num"), kn.street_name_udf("_address").alias("street"), t.blank("_address").alias("blank")
    )
    return r.join(names, "_name").join(places, "_address").drop("_name", "_address")


class Gathered(NamedTuple):
    """``rows``: records (entity_id, country, name, address); ``texts``: those of equal country, name and address as one, prepared, with how many they are (n) and a number as entity_id."""

    rows: DataFrame
    texts: DataFrame

    def filter(self, condition: Column | str) -> Gathered:
        return Gathered(self.rows, self.texts.filter(condition))


Records = DataFrame | Gathered
_TEXT = ("country", "name", "address")


def gathered(*tables: DataFrame) -> tuple[Gathered, ...]:
    """Tables of records, gathered; the texts of all are prepared together."""
    from functools import reduce

    from kinweave.sources.checkpoints import cut

    country = lambda r: F.col("country") if "country" in r.columns else F.lit("").alias("country")
    rows = [r.select("entity_id", country(r), "name", "address") for r in tables]
    # without a least id: strings are not kept in a hash aggregate, and a sort of all records took most of the time
    counts = [r.groupBy(*_TEXT).agg(F.count("*").alias("n")).withColumn("side", F.lit(i)) for i, r in enumerate(rows)]
    texts = cut(reduce(DataFrame.unionByName, counts).withColumn("entity_id", F.monotonically_increasing_id()))
    texts = cut(prepared(texts, "n", "side"))
    return tuple(Gathered(r, texts.filter(F.col("side") == i).drop("side")) for i, r in enumerate(rows))


def _texts(records: Records) -> DataFrame:
    return records.texts if isinstance(records, Gathered) else records


def _sent(rows: DataFrame, most: int = 50_000) -> DataFrame:
    """Rows that have been cut, for a join: sent to all tasks while they are few; none are known as none, so that the other side is not read."""
    n = rows.count()
    return rows.filter("false") if n == 0 else F.broadcast(rows) if n <= most else rows


def _same_text(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` beside the rows ``of`` their country, name and address."""
    of = of.withColumnsRenamed({c: f"_{c}" for c in _TEXT})
    fits = (rows["country"] == of["_country"]) & rows["name"].eqNullSafe(of["_name"]) & rows["address"].eqNullSafe(of["_address"])
    return rows.join(of, fits).drop(*(f"_{c}" for c in _TEXT))


def _by_id(records: Records, ids: DataFrame) -> DataFrame:
    """Prepared records; of gathered ones only those of ``ids`` (entity_id), which have been cut."""
    if not isinstance(records, Gathered):
        return records
    return _same_text(records.rows.join(_sent(ids), "entity_id", "left_semi"), records.texts.drop("entity_id", "n"))


def _query_ids(queries: Records, found: DataFrame) -> DataFrame:
    """``found`` (q_id, p_id) with the queries' own ids, where q_id is the number of a text of one query."""
    from kinweave.sources.checkpoints import cut

    if not isinstance(queries, Gathered):
        return found
    found = found.withColumnRenamed("q_id", "number")
    texts = cut(found.join(queries.texts.select(*_TEXT, F.col("entity_id").alias("number")), "number").select(*_TEXT, "p_id"))
    return _same_text(queries.rows, _sent(texts)).select(F.col("entity_id").alias("q_id"), "p_id")


def _sides(queries: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with prefixes; the country, which every rule joins on, keeps its name."""
    side = lambda r, x: r.select(*(F.col(c) if c == "country" else F.col(c).alias(f"{x}_{'id' if c == 'entity_id' else c}") for c in r.columns))
    return side(queries, "q"), side(pool, "p")


def legal_fits() -> Column:
    """Legal forms agree in one, or a side has none."""
    return (F.size("q_legal") == 0) | (F.size("p_legal") == 0) | F.arrays_overlap("q_legal", "p_legal")


def street_fits() -> Column:
    """Equal, or alike; equal streets, and those too unlike in length, reach the kernel as nulls."""
    q, p = F.col("q_street"), F.col("p_street")
    a, b = F.char_length(q), F.char_length(p)
    open_ = (q != p) & (2 * F.least(a, b) >= MIN_STREET * (a + b))
    return (q == p) | (open_ & (kn.ratio_udf(F.when(open_, q), F.when(open_, p)) >= MIN_STREET))


def _groups(queries: Records, pool: Records, *names: str) -> tuple[DataFrame, DataFrame]:
    """Records of a side that agree in country and ``names`` as one row, prefixed; the queries' say how many (n) and name one (q_id)."""
    side = lambda r, x: r.select("country", *(F.col(c).alias(f"{x}_{c}") for c in names), *(c for c in ("n", "q_id") if c in r.columns))
    n = F.sum("n") if isinstance(queries, Gathered) else F.count("*")
    q = _texts(queries).groupBy("country", *names).agg(n.alias("n"), F.min("entity_id").alias("q_id"))
    return side(q, "q"), side(_texts(pool).select("country", *names).distinct(), "p")


def _sole(claims: DataFrame, pool: Records, *names: str) -> DataFrame:
    """(q_id, p_id) of the pool records that exactly one query claims.

    ``claims`` (country, p_<names>, n, q_id) are claims of groups on groups of
    :func:`_groups`.  They are added up before records are named, so the rows
    are as many as records and groups, not as pairs of records.  Of gathered
    records only those whose text has one claim are named, and what else
    claims their ids.
    """
    total = lambda r, *by: r.groupBy(*by).agg(F.sum("n").alias("n"), F.min("q_id").alias("q_id"))
    each = total(claims, "country", *(F.col(f"p_{c}").alias(c) for c in names))
    if isinstance(pool, Gathered):
        found = total(_claimed(pool, each, *names), "entity_id")
    else:
        found = total(pool.select("entity_id", "country", *names).join(each, ["country", *names]), "entity_id")
    return found.filter("n = 1").select("q_id", F.col("entity_id").alias("p_id"))


def _claimed(pool: Gathered, each: DataFrame, *names: str) -> DataFrame:
    """(entity_id, n, q_id) of the claims ``each`` on groups of the pool, for the records whose text has one claim; an id on several records has several rows."""
    from kinweave.sources.checkpoints import cut

    texts = cut(pool.texts.select(*dict.fromkeys((*_TEXT, *names))).join(each, ["country", *names]).select(*_TEXT, "n", "q_id"))
    named = lambda n: _same_text(pool.rows, _sent(texts.filter(n))).select("entity_id", "n", "q_id")
    once = cut(named("n = 1"))
    return once.unionByName(named("n > 1").join(_sent(once.select("entity_id")), "entity_id", "left_semi"))


def _same_key(queries: DataFrame, pool: DataFrame, *names: str) -> DataFrame:
    """Groups of both sides with the same core words, and the same number if ``names`` has it; legal forms and streets are alike."""
    q, p = _groups(queries.filter("key is not null"), pool.filter("key is not null"), "key", "legal", *names)
    same = [c for c in ("key", "num") if c == "key" or c in names]
    j = q.withColumns({c: F.col(f"q_{c}") for c in same}).join(p.withColumns({c: F.col(f"p_{c}") for c in same}), ["country", *same]).filter(legal_fits())
    return j.filter(street_fits()) if "street" in names else j


def exact_core(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """The same core words; number and street agree, or the candidate has no address."""
    q, p = queries.filter("num <> '' and street <> ''"), pool.filter("not blank and num <> '' and street <> ''")
    at = ("num", "street")
    placed = _sole(_same_key(q, p, *at), p, "key", "legal", *at)
    bare = _sole(_same_key(queries, pool.filter("blank")), pool.filter("blank"), "key", "legal")
    return placed.withColumn("kind", F.lit("addr")).unionByName(bare.withColumn("kind", F.lit("empty")))


def number_missing(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """The same core words and street; the candidate has no number."""
    q, p = queries.filter("street <> ''"), pool.filter("not blank and num = '' and street <> ''")
    return _sole(_same_key(q, p, "street"), p, "key", "legal", "street").withColumn("kind", F.lit("nonum"))


def _placed(queries: Records, pool: Records) -> tuple[Records, Records]:
    return queries.filter("num <> '' and street <> ''"), pool.filter("num <> '' and street <> '' and not blank")


def _at_address(q: DataFrame, p: DataFrame, *names: str) -> DataFrame:
    """The query groups ``q`` at the addresses of the pool groups ``p``, added up for equal ``names``: (country, num, p_street, names, n, q_id).

    Streets are compared once for each number.
    """
    a = q.select("country", F.col("q_num").alias("num"), "q_street").distinct()
    b = p.select("country", F.col("p_num").alias("num"), "p_street").distinct()
    begins = F.substring("q_street", 1, 3) == F.substring("p_street", 1, 3)
    fits = a.join(b, ["country", "num"]).filter(begins).filter(street_fits())
    j = q.withColumn("num", F.col("q_num")).join(fits, ["country", "num", "q_street"])
    return j.groupBy("country", "num", "p_street", *names).agg(F.sum("n").alias("n"), F.min("q_id").alias("q_id"))


def aligned(queries: Records, pool: Records, mode: str = "typo") -> DataFrame:
    """At the same address, core words that align: all of them ("typo"), or with words dropped ("del") or added ("add")."""
    a, b = F.size("q_key"), F.size("p_key")
    fits = {"typo": a == b, "del": (b > 0) & (b < a), "add": (a > 0) & (a < b)}[mode]
    queries, pool = (r.filter("key is not null") for r in _placed(queries, pool))
    names = ("num", "street", "key", "legal")
    q, p = _groups(queries, pool, *names)
    near = _at_address(q, p, "q_key", "q_legal")
    j = near.join(p.withColumn("num", F.col("p_num")), ["country", "num", "p_street"]).filter(fits).filter(legal_fits())
    long, short = ("p_key", "q_key") if mode == "add" else ("q_key", "p_key")
    # words that are all found as they are need no kernel; others reach it once a pair of names
    plain = F.size(F.array_except(short, long)) == 0
    plain = plain & (F.size(F.array_distinct(short)) == F.size(short))
    open_ = lambda c: F.when(~plain, F.array_join(c, " "))
    found = _sole(j.filter(plain | (kn.align_words_udf(open_(long), open_(short)) > 0)), pool, *names)
    return _query_ids(queries, found).withColumn("kind", F.lit(mode))


def sole_at_address(queries: Records, pool: Records, relation: str, compat: bool = False) -> DataFrame:
    """The only query at the candidate's address, without a common word, and related by name.

    "domain": the query's joined words are in the candidate's squeezed name;
    "acro": the candidate's first word is the query's initials; "pseudo": the
    candidate is one invented word; "any": no name test.  ``compat`` joins the
    words in alphabetical order instead of their own.
    """
    from kinweave.sources.checkpoints import cut

    at = ("num", "street")
    here, there = _placed(queries, pool)
    groups = _groups(here, there, *at)
    only = _query_ids(here, _sole(_at_address(*groups).withColumn("p_num", F.col("num")), there, *at))
    if isinstance(queries, Gathered) or isinstance(pool, Gathered):
        only = cut(only)
    q, p = _sides(_by_id(queries, only.select(F.col("q_id").alias("entity_id"))), _by_id(pool, only.select(F.col("p_id").alias("entity_id"))))
    j = only.join(q, "q_id").join(p.drop("country"), "p_id")
    none = F.array().cast("array<string>")
    qw, pw = F.coalesce(F.col("q_key" if compat else "q_words"), none), F.coalesce(F.col("p_key" if compat else "p_words"), none)
    j = j.filter(~F.arrays_overlap(qw, pw))
    joined = F.array_join(qw, "")
    squeezed = F.regexp_replace(F.lower("p_name"), r"[\s_-]", "")
    if relation == "domain":
        j = j.filter((F.char_length(joined) >= 5) & squeezed.contains(joined))
    elif relation == "acro":
        initials = F.array_join(F.transform(qw, lambda w: F.substring(w, 1, 1)), "")
        j = j.filter((F.size(qw) >= 2) & (F.try_element_at(pw, F.lit(1)) == initials))
    elif relation == "pseudo":
        word = F.try_element_at(pw, F.lit(1))
        j = j.filter((F.size(pw) == 1) & (F.char_length(word) >= 5) & word.rlike("^[a-z]+$") & (F.size("p_legal") == 0)).withColumn("word", word)
        known = _texts(queries).select("country", F.explode("key").alias("word")).distinct()
        j = j.join(known, ["country", "word"], "left_anti")
    elif relation != "any":
        raise ValueError(relation)
    return j.select("q_id", "p_id", F.lit(relation).alias("kind"))


def vocabulary(queries: DataFrame, min_names: int = 30) -> DataFrame:
    """(country, word, n): words of more than two letters in the core names of at least ``min_names`` queries of a country."""
    each = queries.select("country", F.explode(F.array_distinct("key")).alias("word"))
    return each.groupBy("country", "word").agg(F.count("*").alias("n")).filter((F.col("n") >= min_names) & (F.char_length("word") > 2))


def descriptor_swap(matches: DataFrame, queries: DataFrame, pool: DataFrame, min_names: int = 30) -> DataFrame:
    """Matches without extras that only swap one common descriptor for another.  ``matches``: (q_id, p_id, rank); rank 0 stays."""
    q, p = _sides(queries.select("entity_id", "country", "key"), pool.select("entity_id", "key"))
    common = vocabulary(queries, min_names)
    j = matches.join(q, "q_id").join(p, "p_id")
    added, dropped = F.array_except("p_key", "q_key"), F.array_except("q_key", "p_key")
    swap = j.filter((F.col("rank") > 0) & (F.size(added) > 0) & (F.size(dropped) > 0) & F.arrays_overlap("q_key", "p_key"))
    changed = swap.select("q_id", "p_id", "country", F.explode(F.concat(added, dropped)).alias("word"))
    rare = changed.join(common, ["country", "word"], "left_anti").select("q_id", "p_id").distinct()
    gone = swap.select("q_id", "p_id").join(rare, ["q_id", "p_id"], "left_anti")
    return matches.join(gone, ["q_id", "p_id"], "left_anti")


def competition(matches: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Matches without extras whose core name is another query's of the country and not their own."""
    q, p = _sides(queries.select("entity_id", "country", "key"), pool.select("entity_id", "key"))
    taken = queries.filter("key is not null").select("country", F.col("key").alias("p_key")).distinct()
    j = matches.filter("rank > 0").join(q, "q_id").join(p, "p_id").filter("p_key <> q_key")
    gone = j.join(taken, ["country", "p_key"], "left_semi").select("q_id", "p_id")
    return matches.join(gone, ["q_id", "p_id"], "left_anti")


def empty_address(matches: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Unowned candidates without address whose core name has one query in their country, one that is matched already."""
    free = pool.filter("blank and key is not null").join(matches.select(F.col("p_id").alias("entity_id")), "entity_id", "left_anti")
    owner = queries.filter("key is not null").groupBy("country", "key").agg(F.count("*").alias("n"), F.first("entity_id").alias("q_id")).filter("n = 1")
    j = free.join(owner, ["country", "key"]).select("q_id", F.col("entity_id").alias("p_id"))
    return j.join(matches, "q_id", "left_semi").withColumn("kind", F.lit("empty"))


def unowned(pool: DataFrame, matches: DataFrame) -> DataFrame:
    return pool.join(matches.select(F.col("p_id").alias("entity_id")), "entity_id", "left_anti")


def apply_rules(matches: DataFrame, queries: DataFrame, pool: DataFrame, rules) -> DataFrame:
    """Each rule in turn sees the candidates that are still unowned; (q_id, p_id, step), step 0 for the given matches."""
    from kinweave.sources.checkpoints import cut

    out = matches.select("q_id", "p_id").withColumn("step", F.lit(0))
    for i, rule in enumerate(rules, 1):
        found = rule(queries, unowned(pool, out)).select("q_id", "p_id")
        out = cut(out.unionByName(found.withColumn("step", F.lit(i))))
    return out


def precision(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(kind, n, precision) of proposed pairs, against (q_id, p_id)."""
    y = found.join(truth.select("q_id", "p_id", F.lit(1.0).alias("y")), ["q_id", "p_id"], "left")
    return y.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("y", F.lit(0.0))), 6).alias("precision"))


def harness(rules: dict, queries: DataFrame, pool: DataFrame, truth: DataFrame, share: float = 0.15) -> DataFrame:
    """(rule, kind, n, precision, fired): each rule alone on a hash sample of the pool, whatever a model says.

    ``rules`` maps names to functions of (queries, pool); ``fired`` is the rule's share of the sample.
    """
    from functools import reduce

    from kinweave.operators.blocking import sample_by_hash
    from kinweave.sources.checkpoints import cut

    sample = cut(sample_by_hash(pool, share))  # drawn once, as every rule reads it often
    size = F.greatest(F.lit(sample.count()), F.lit(1))
    found = [precision(rule(queries, sample), truth).withColumn("rule", F.lit(name)) for name, rule in rules.items()]
    return reduce(DataFrame.unionByName, found).select("rule", "kind", "n", "precision", F.round(F.col("n") / size, 6).alias("fired"))

"""Research papers: relevance, normalisation, claims, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a relevant paper speaks of.
TOPICS = ("momentum", "reversal", "volatility", "return", "portfolio", "trading", "market", "factor", "risk", "asset", "price", "anomaly")


def relevant(text: Column, topics: tuple[str, ...] = TOPICS) -> Column:
    return text.rlike(rf"(?i)\b(?:{'|'.join(topics)})\b")


def base_id(paper: Column) -> Column:
    return F.regexp_replace(paper, r"v\d+$", "")


def unknown(papers: DataFrame, known: DataFrame) -> DataFrame:
    """One row per base id that is not known yet, the latest version."""
    keyed = papers.withColumn("base", base_id(F.col("arxiv_id")))
    newest = keyed.withColumn("_n", F.row_number().over(W.partitionBy("base").orderBy(F.desc("arxiv_id")))).where("_n = 1").drop("_n")
    return newest.join(known.select(base_id(F.col("arxiv_id")).alias("base")).distinct(), "base", "left_anti")


def abstracts(rows: DataFrame) -> DataFrame:
    """(id, abstract) of (id, inverted: word -> positions)."""
    words = rows.select("id", F.explode("inverted").alias("word", "at")).select("id", "word", F.explode("at").alias("pos"))
    return words.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("abstract"))


def normal_title(title: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def normal_concept(raw: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.lower(raw)), r"[^a-z0-9]+", "-"), 1, 64)


def bare_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(doi), r"^https?://(dx\.)?doi\.org/", "")


WORK = "struct<id:string, doi:string, title:string, landing_page_url:string, abstract_inverted_index:map<string, array<int>>>"


def works(landed: DataFrame, domains: DataFrame) -> DataFrame:
    """Records with an id and a title whose page lies in one of the domains (host)."""
    w = landed.select(F.from_json("body", WORK).alias("w")).select("w.*").where("id is not null and title is not null")
    host = F.regexp_extract("landing_page_url", r"^https?://(?:www\.)?([^/]+)", 1)
    return w.withColumn("host", host).join(domains.select("host"), "host", "left_semi").drop("host").withColumn("doi", bare_doi(F.col("doi")))


def titles(markdown: DataFrame) -> DataFrame:
    """(id, place, title) of the first cells of a table's rows, each title once."""
    cells = markdown.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^\|\s*\[?([^\]|]+?)\]?(?:\([^)]*\))?\s*\|"), F.lit(1))).alias("place", "title"))
    body = cells.where(~F.col("title").rlike("^[-: ]*$"))
    return body.groupBy("id", "title").agg(F.min("place").alias("place"))


CLAIMS = "array<struct<claim:string, family_hint:string, asset_class:string, testable:boolean, concepts:array<string>>>"


def claims(extractions: DataFrame, families: list[str], most: int = 5, concepts: int = 8) -> DataFrame:
    """Claims of stored extractions (paper_id, body); a paper with a bad claim gives none, others are not touched."""
    rows = extractions.select("paper_id", F.from_json("body", CLAIMS).alias("cs"))
    fine = rows.where(F.col("cs").isNotNull() & F.forall("cs", lambda c: c["claim"].isNotNull() & (c["family_hint"].isNull() | c["family_hint"].isin(families))))
    out = fine.select("paper_id", F.posexplode(F.slice("cs", 1, most)).alias("place", "c"))
    tags = F.slice(F.array_distinct(F.transform("c.concepts", normal_concept)), 1, concepts)
    return out.select("paper_id", "place", "c.claim", "c.family_hint", "c.asset_class", F.coalesce("c.testable", F.lit(False)).alias("testable"), tags.alias("concepts"))


#: Pairs that one task of the join makes and counts, some 100 MB.
PAIRS = 1 << 20


def link_candidates(tags: DataFrame, n: int = 10) -> DataFrame:
    """For each claim, the n older claims of other papers that share most concepts; tags (claim_id, paper_id, concept).

    Tags are few beside their pairs, and a task that gets as many tags as others would make any number of pairs. So pairs are
    counted first, by concept, and dealt to as many tasks as they need: what one task holds does not grow with the tables.
    """
    pairs_n = tags.groupBy("concept").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n")).first()["n"] or 0
    tasks = int(min(pairs_n // PAIRS + 1, 20_000))
    a, b = tags.repartition(tasks, "concept").alias("a"), tags.repartition(tasks, "concept").alias("b")
    pairs = a.join(b, F.col("a.concept") == F.col("b.concept")).where("b.claim_id < a.claim_id and b.paper_id <> a.paper_id")
    dealt = pairs.select(F.col("a.claim_id").alias("claim_id"), F.col("b.claim_id").alias("other")).repartition(tasks, "claim_id")
    shared = dealt.groupBy("claim_id", "other").agg(F.count("*").alias("shared"))
    order = W.partitionBy("claim_id").orderBy(F.desc("shared"), F.desc("other"))
    return shared.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def untested(claims_: DataFrame, hypotheses: DataFrame, links: DataFrame, classes: list[str]) -> DataFrame:
    """Testable claims with a hint that no hypothesis names, by how many links support them."""
    used = hypotheses.select(F.explode("claim_ids").alias("id")).distinct()
    support = links.where("relation = 'SUPPORTS'")
    n = support.select(F.col("claim_a").alias("id")).unionByName(support.select(F.col("claim_b").alias("id"))).groupBy("id").agg(F.count("*").alias("supports"))
    fit = claims_.where(F.col("testable") & F.col("family_hint").isNotNull() & F.col("asset_class").isin(classes))
    return fit.join(used, "id", "left_anti").join(n, "id", "left").withColumn("supports", F.coalesce("supports", F.lit(0))).orderBy(F.desc("supports"), "id")


def by_relation(links: DataFrame) -> DataFrame:
    return links.groupBy("relation").agg(F.count("*").alias("n"))


def with_concepts(claims_: DataFrame, tags: DataFrame) -> DataFrame:
    own = tags.groupBy("claim_id").agg(F.array_sort(F.collect_list("concept")).alias("concepts"))
    return claims_.join(own, F.col("id") == F.col("claim_id"), "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>"))).drop("claim_id")


def links_of(links: DataFrame, papers_of: DataFrame) -> DataFrame:
    """(paper_id, claim_id, other, direction): links inside one paper once, as outgoing; papers_of (claim_id, paper_id)."""
    p = papers_of.select("claim_id", "paper_id")
    out = links.join(p, F.col("claim_a") == F.col("claim_id")).select("paper_id", "claim_id", F.col("claim_b").alias("other"), "relation", F.lit("out").alias("direction"))
    inc = links.join(p, F.col("claim_b") == F.col("claim_id")).select("paper_id", "claim_id", F.col("claim_a").alias("other"), "relation", F.lit("in").alias("direction"))
    same = p.select(F.col("claim_id").alias("other"), "paper_id")
    return out.unionByName(inc.join(same, ["other", "paper_id"], "left_anti").select(out.columns))


def page(papers: DataFrame, size: int, number: int) -> DataFrame:
    return papers.orderBy(F.desc("published_at"), "id").offset(size * number).limit(size)


def new_links(links: DataFrame, stored: DataFrame) -> DataFrame:
    """Links that are not stored yet, one for each pair of claims."""
    first = links.groupBy("claim_a", "claim_b").agg(F.min("relation").alias("relation"))
    return first.join(stored.select("claim_a", "claim_b"), ["claim_a", "claim_b"], "left_anti")


def unextracted(papers: DataFrame, extractions: DataFrame, most: int = 2) -> DataFrame:
    """Papers without a readable extraction and with fewer than ``most`` attempts, the newest first."""
    tried = extractions.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("attempts"), F.count_if(~F.col("model").like("%:unparseable")).alias("read"))
    return papers.join(tried.where((F.col("read") > 0) | (F.col("attempts") >= most)).select("id"), "id", "left_anti").orderBy(F.desc("id"))


def refinement_parents(evidence: DataFrame, hypotheses: DataFrame, rotation: list[str]) -> DataFrame:
    """Evidence without a hypothesis built on it, most consistent first; rotation families are left out."""
    used = hypotheses.select(F.col("parent_config_hash").alias("config_hash"))
    left = evidence.where(~F.col("family").isin(rotation)).join(used, "config_hash", "left_anti")
    return left.orderBy(F.desc_nulls_last("icir"), F.desc_nulls_last("score"), "config_hash")


def summary(papers: DataFrame, extractions: DataFrame, claims_: DataFrame, links: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row of counts."""
    off_topic, unread = F.col("model") == "relevance-filter", F.col("model").like("%:unparseable")
    parts = [
        papers.agg(F.count("*").alias("papers")),
        extractions.agg(F.count_distinct(F.when(~off_topic & ~unread, F.col("paper_id"))).alias("papers_extracted"), F.count_distinct(F.when(off_topic, F.col("paper_id"))).alias("papers_off_topic")),
        claims_.agg(F.count("*").alias("claims"), F.count_if("testable").alias("testable_claims")),
        links.agg(F.count("*").alias("links")),
        hypotheses.agg(F.count_if(F.col("claim_ids").isNotNull() & (F.col("fingerprint") != "unparseable")).alias("hypotheses_from_claims")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # single rows
    return out


def learned(hypotheses: DataFrame, claims_: DataFrame, strategies: DataFrame) -> DataFrame:
    """(hypothesis_id, claim_id, paper_id, strategy_id, status): each claim of a hypothesis, and the newest strategy built from it."""
    readable = hypotheses.where("fingerprint <> 'unparseable'").select(F.col("id").alias("hypothesis_id"), "fingerprint", F.explode("claim_ids").alias("claim_id"))
    built = strategies.where("source = 'llm_hypothesis'").groupBy(F.col("config_hash").alias("fingerprint")).agg(F.max_by(F.struct(F.col("id").alias("strategy_id"), "status"), F.struct("created_at", "id")).alias("s"))
    both = readable.join(claims_.select(F.col("id").alias("claim_id"), "paper_id"), "claim_id").join(built, "fingerprint", "left")
    return both.select("hypothesis_id", "claim_id", "paper_id", "s.strategy_id", "s.status")

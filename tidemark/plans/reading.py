"""Research papers: versions, records, titles, claims, links and what was learned from them, over derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import papers
from tidemark.plans.registry import query
from tidemark.plans.research import _LINKS, links
from tidemark.sources.experiments import STRATEGIES_SQL, VALIDATIONS_SQL, strategies, validations
from tidemark.sources.market import table

_VERSIONS = "versions AS (SELECT p_partkey AS id, '2401.' || (p_partkey // 3) AS base, '2401.' || (p_partkey // 3) || 'v' || (p_partkey % 3 + 1) AS arxiv_id FROM part)"


@query("papers_unknown", f"WITH {_VERSIONS} SELECT base, max(arxiv_id) AS arxiv_id FROM versions WHERE base NOT IN (SELECT base FROM versions WHERE id % 10 = 0) GROUP BY base")
def papers_unknown(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("2401."), F.floor(k / 3).cast("string"), F.lit("v"), (k % 3 + 1).cast("string")).alias("arxiv_id"))
    return papers.unknown(rows, rows.where("id % 10 = 0")).select("base", "arxiv_id")


@query("papers_works", r"""WITH w AS (SELECT CASE WHEN page_id % 7 <> 0 THEN 'W' || page_id END AS id, '10.1/x' || page_id AS doi, CASE WHEN page_id % 5 <> 0 THEN 'Title ' || page_id END AS title, regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) AS host FROM pages),
top AS (SELECT regexp_extract(url, '^https?://(?:www\.)?([^/]+)', 1) AS host FROM pages WHERE page_id % 2 = 0)
SELECT id, doi, title FROM w WHERE id IS NOT NULL AND title IS NOT NULL AND host IN (SELECT host FROM top)""")  # fmt: skip
def papers_works(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    hosts = pages.where("page_id % 2 = 0").select(F.regexp_extract("url", r"^https?://(?:www\.)?([^/]+)", 1).alias("host")).distinct()
    k = F.col("page_id")
    body = F.to_json(F.struct(
        F.when(k % 7 != 0, F.concat(F.lit("W"), k.cast("string"))).alias("id"), F.concat(F.lit("https://doi.org/10.1/X"), k.cast("string")).alias("doi"),
        F.when(k % 5 != 0, F.concat(F.lit("Title "), k.cast("string"))).alias("title"), F.col("url").alias("landing_page_url"),
    ))
    return papers.works(pages.select(body.alias("body")), hosts).select("id", "doi", "title")


@query("papers_titles", """WITH p AS (SELECT p_brand AS id, p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS place FROM part)
SELECT id, title, min(place) AS place FROM (SELECT id, title, place FROM p UNION ALL SELECT DISTINCT id, 'Strategy', 0 FROM p) GROUP BY ALL""")  # fmt: skip
def papers_titles(spark, sf_dir):
    line = F.concat(F.lit("| ["), F.col("p_name"), F.lit("](https://a.b/"), F.col("p_partkey").cast("string"), F.lit(") | x |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"])
    tables_ = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.concat(F.lit("# List\n\n| Strategy | Note |\n|---|---|\n"), F.array_join(lines, "\n")).alias("text"))
    return papers.titles(tables_)


@query("papers_claims", """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 4 = 0 THEN 7 ELSE 2 END AS n, o_orderkey % 6 = 0 AS bad FROM orders),
x AS (SELECT k, c, unnest(range(0, n)) AS place FROM o WHERE NOT bad)
SELECT k AS paper_id, CAST(place AS INTEGER) AS place, 'claim ' || c || ' ' || place AS claim, CASE WHEN place % 2 = 0 THEN 'RSI' END AS family_hint, k % 3 = 0 AS testable, 'trend-' || c || ',b-' || place AS concepts FROM x WHERE place < 5""")  # fmt: skip
def papers_claims(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    hint = lambda i: F.when((k % 6 == 0) & (i == 1), "NO_SUCH").when(i % 2 == 0, "RSI")
    tags = lambda i: F.array(F.concat(F.lit(" Trend  "), c), F.concat(F.lit("b/"), i.cast("string")), F.concat(F.lit("TREND "), c))
    one = lambda i: F.struct(F.concat(F.lit("claim "), c, F.lit(" "), i.cast("string")).alias("claim"), hint(i).alias("family_hint"), F.when(k % 3 == 0, True).alias("testable"), tags(i).alias("concepts"))
    body = F.to_json(F.transform(F.sequence(F.lit(0), F.when(k % 4 == 0, 6).otherwise(1)), one))
    out = papers.claims(table(spark, sf_dir, "orders").select(k.alias("paper_id"), body.alias("body")), ["RSI", "MACD"])
    return out.select("paper_id", "place", "claim", "family_hint", "testable", F.array_join("concepts", ",").alias("concepts"))


@query("concept_tags", "SELECT substr(regexp_replace(trim(lower(p_name)), '[^a-z0-9]+', '-', 'g'), 1, 64) AS concept, count(*) AS n FROM part GROUP BY 1")
def concept_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(papers.normal_concept(F.col("p_name")).alias("concept")).agg(F.count("*").alias("n"))


_TAGGED = "tagged AS (SELECT DISTINCT l_orderkey AS claim_id, l_orderkey % 1000 AS paper_id, l_partkey AS concept FROM lineitem)"


def _tagged(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_orderkey") % 1000).alias("paper_id"), F.col("l_partkey").alias("concept")).distinct()


@query("link_candidates", f"""WITH {_TAGGED},
shared AS (SELECT a.claim_id, b.claim_id AS other, count(*) AS shared FROM tagged a JOIN tagged b ON a.concept = b.concept AND b.claim_id < a.claim_id AND b.paper_id <> a.paper_id GROUP BY ALL)
SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY shared DESC, other DESC) <= 10""")  # fmt: skip
def link_candidates(spark, sf_dir):
    return papers.link_candidates(_tagged(spark, sf_dir))


@query("links_new", f"WITH {_LINKS}, f AS (SELECT claim_a, claim_b, min(relation) AS relation FROM links GROUP BY ALL) SELECT * FROM f WHERE (claim_a, claim_b) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_linenumber = 1)")
def links_new(spark, sf_dir):
    stored = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("claim_a"), F.col("l_partkey").alias("claim_b"))
    return papers.new_links(links(spark, sf_dir), stored)


_EXTRACTIONS = "extractions AS (SELECT o_custkey AS paper_id, CASE WHEN o_orderstatus = 'F' THEN 'm:unparseable' WHEN o_orderpriority LIKE '1%' THEN 'relevance-filter' ELSE 'm' END AS model FROM orders)"


def _extractions(spark, sf_dir):
    model = F.when(F.col("o_orderstatus") == "F", "m:unparseable").when(F.col("o_orderpriority").like("1%"), "relevance-filter").otherwise("m")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paper_id"), model.alias("model"))


@query("papers_unextracted", f"""WITH {_EXTRACTIONS} SELECT c_custkey AS id FROM customer
WHERE c_custkey NOT IN (SELECT paper_id FROM extractions WHERE model NOT LIKE '%:unparseable') AND c_custkey NOT IN (SELECT paper_id FROM extractions GROUP BY paper_id HAVING count(*) >= 8)""")  # fmt: skip
def papers_unextracted(spark, sf_dir):
    return papers.unextracted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), _extractions(spark, sf_dir), 8)


@query("refinement_parents", f"""WITH {VALIDATIONS_SQL},
e AS (SELECT fingerprint AS config_hash, icir, score FROM validations QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, id DESC) = 1)
SELECT config_hash, icir, score FROM e WHERE config_hash NOT IN (SELECT 'h' || (c_custkey % 400) FROM customer WHERE c_custkey % 4 = 0) AND NOT config_hash LIKE '%9'""")  # fmt: skip
def refinement_parents(spark, sf_dir):
    last = validations(spark, sf_dir).groupBy(F.col("fingerprint").alias("config_hash")).agg(F.max_by(F.struct("metrics.icir", "score"), F.struct("created_at", "id")).alias("s")).select("config_hash", "s.*")
    evidence = last.withColumn("family", F.when(F.col("config_hash").like("%9"), "GTAA_SMA_TIMING").otherwise("RSI"))
    used = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("h"), (F.col("c_custkey") % 400).cast("string")).alias("parent_config_hash"))
    return papers.refinement_parents(evidence, used, ["GTAA_SMA_TIMING"]).select("config_hash", "icir", "score")


@query("papers_page", "SELECT doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def papers_page(spark, sf_dir):
    return papers.page(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("published_at")), 25, 2).select("id")


_CLAIMED = "claimed AS (SELECT p_partkey AS id, p_size AS paper_id, p_size % 2 = 0 AS testable FROM part)"
_ASKED = "asked AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'unparseable' ELSE 'h' || (o_custkey % 400) END AS fingerprint, CASE WHEN o_orderkey % 5 <> 0 THEN [o_orderkey % 100, o_orderkey % 77 + 200] END AS claim_ids FROM orders)"


def _claimed(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("paper_id"), (F.col("p_size") % 2 == 0).alias("testable"))


def _asked(spark, sf_dir):
    k = F.col("o_orderkey")
    print_ = F.when(k % 9 == 0, "unparseable").otherwise(F.concat(F.lit("h"), (F.col("o_custkey") % 400).cast("string")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), print_.alias("fingerprint"), F.when(k % 5 != 0, F.array(k % 100, k % 77 + 200)).alias("claim_ids"))


@query("papers_summary", f"""WITH {_EXTRACTIONS}, {_CLAIMED}, {_ASKED}
SELECT (SELECT count(*) FROM customer) AS papers, (SELECT count(DISTINCT paper_id) FROM extractions WHERE model = 'm') AS papers_extracted, (SELECT count(DISTINCT paper_id) FROM extractions WHERE model = 'relevance-filter') AS papers_off_topic,
       (SELECT count(*) FROM claimed) AS claims, (SELECT count(*) FROM claimed WHERE testable) AS testable_claims, (SELECT count(*) FROM lineitem) AS links,
       (SELECT count(*) FROM asked WHERE claim_ids IS NOT NULL AND fingerprint <> 'unparseable') AS hypotheses_from_claims""")  # fmt: skip
def papers_summary(spark, sf_dir):
    return papers.summary(table(spark, sf_dir, "customer"), _extractions(spark, sf_dir), _claimed(spark, sf_dir), links(spark, sf_dir), _asked(spark, sf_dir))


@query("claims_with_concepts", f"WITH {_TAGGED} SELECT o_orderkey AS id, coalesce(string_agg(CAST(concept AS VARCHAR), ',' ORDER BY concept), '') AS concepts FROM orders LEFT JOIN tagged ON claim_id = o_orderkey GROUP BY o_orderkey")
def claims_with_concepts(spark, sf_dir):
    out = papers.with_concepts(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).distinct(), _tagged(spark, sf_dir).withColumn("concept", F.lpad(F.col("concept").cast("string"), 9, "0")))
    return out.select("id", F.array_join(F.transform("concepts", lambda c: c.cast("long").cast("string")), ",").alias("concepts"))


@query("paper_links", f"""WITH {_LINKS},
p AS (SELECT o_orderkey AS claim_id, o_orderkey % 50 AS paper_id FROM (SELECT DISTINCT o_orderkey FROM orders)),
o AS (SELECT p.paper_id, p.claim_id, l.claim_b AS other, relation, 'out' AS direction FROM links l JOIN p ON l.claim_a = p.claim_id),
i AS (SELECT p.paper_id, p.claim_id, l.claim_a AS other, relation, 'in' AS direction FROM links l JOIN p ON l.claim_b = p.claim_id WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.claim_id = l.claim_a AND q.paper_id = p.paper_id))
SELECT * FROM o UNION ALL SELECT * FROM i""")  # fmt: skip
def paper_links(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") % 50).alias("paper_id")).distinct()
    return papers.links_of(links(spark, sf_dir), own)


@query("papers_learned", f"""WITH {_CLAIMED}, {_ASKED}, {STRATEGIES_SQL},
built AS (SELECT config_hash, id AS strategy_id, status FROM strategies WHERE id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY config_hash ORDER BY created_at DESC, id DESC) = 1),
r AS (SELECT id AS hypothesis_id, fingerprint, unnest(claim_ids) AS claim_id FROM asked WHERE fingerprint <> 'unparseable')
SELECT hypothesis_id, claim_id, paper_id, strategy_id, status FROM r JOIN claimed c ON c.id = r.claim_id LEFT JOIN built ON config_hash = fingerprint""")  # fmt: skip
def papers_learned(spark, sf_dir):
    s = strategies(spark, sf_dir).withColumn("source", F.when(F.col("id") % 4 == 0, "llm_hypothesis").otherwise("grid"))
    return papers.learned(_asked(spark, sf_dir), _claimed(spark, sf_dir), s)

"""The operators of this subpackage on their whole tables, with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from listwatch.llm import toxicity
from listwatch.llm.digest_index import ExactDedup
from listwatch.llm.divergence import Divergence
from listwatch.llm.layout import visible_text
from listwatch.llm.licences import LicenceScan
from listwatch.llm.middle import FillInMiddle
from listwatch.llm.mixing import Mixture
from listwatch.llm.packages import WarcPackages
from listwatch.llm.packing import Packing
from listwatch.llm.quotes import QuotationLinks
from listwatch.llm.token_groups import JaccardJoin
from listwatch.llm.trust import Rule, TrustFilter
from listwatch.llm.whitening import Whitening
from listwatch.plans.registry import query

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

DOMAIN = ("CASE WHEN source = 'src0' THEN 'web' WHEN try_cast(substring(source, 4) AS INT) < 10 THEN 'reference' "
          "WHEN source IS NOT NULL THEN 'forum' END")
#: Target weights by level; every source of a language weighs alike.
TARGET = {"domains": {"web": 3, "reference": 5, "forum": 2, "": 1}, "langs": {"en": 6, "de": 2, "fr": 1, "es": 1, "*": 1},
          "sources": {"*": 1}, "domain": DOMAIN}

RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/"))


@query("op1_ngram_jaccard_join", "")
def op1(t):
    """Near-copy components of all documents: 3-word shingles, similarity of 0.9 or more."""
    found = JaccardJoin(words=3, percent=90).components(t.documents)
    return found.select("doc_id", "n_shingles", "component_id", "class_size")


MIXING_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(CASE WHEN source = 'src0' THEN 'web' WHEN try_cast(substring(source, 4) AS INT) < 10 THEN 'reference'
                               WHEN source IS NOT NULL THEN 'forum' END, '') AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
         coalesce(cast(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key
  FROM documents),
leaf AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, 4 * sum(tokens)::BIGINT AS cap, 1::BIGINT AS w3,
         CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END::BIGINT AS w2,
         CASE domain WHEN 'web' THEN 3 WHEN 'reference' THEN 5 WHEN 'forum' THEN 2 ELSE 1 END::BIGINT AS w1
  FROM d GROUP BY ALL),
l1 AS (SELECT domain, any_value(w1) AS w, sum(cap)::BIGINT AS cap, (SELECT sum(tokens)::BIGINT FROM leaf) AS b FROM leaf GROUP BY domain),
a1 AS (SELECT *, cap / w AS r,
         (b - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM l1),
g1 AS (SELECT *, max(level) FILTER (r >= level) OVER () AS t FROM a1),
b1 AS (SELECT domain, CASE WHEN t IS NULL OR r < t THEN cap ELSE least(floor(t * w)::BIGINT, cap) END AS b FROM g1),
l2 AS (SELECT domain, lang, any_value(w2) AS w, sum(cap)::BIGINT AS cap, any_value(b) AS b FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang),
a2 AS (SELECT *, cap / w AS r,
         (b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM l2),
g2 AS (SELECT *, max(level) FILTER (r >= level) OVER (PARTITION BY domain) AS t FROM a2),
b2 AS (SELECT domain, lang, CASE WHEN t IS NULL OR r < t THEN cap ELSE least(floor(t * w)::BIGINT, cap) END AS b FROM g2),
a3 AS (SELECT *, cap / w3 AS r,
         (b - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w3, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(w3) OVER (PARTITION BY domain, lang ORDER BY cap / w3, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
       FROM leaf JOIN b2 USING (domain, lang)),
g3 AS (SELECT *, max(level) FILTER (r >= level) OVER (PARTITION BY domain, lang) AS t FROM a3),
plan AS (SELECT domain, lang, source, tokens, CASE WHEN t IS NULL OR r < t THEN cap ELSE least(floor(t * w3)::BIGINT, cap) END AS given FROM g3),
e AS (SELECT d.doc_id, domain, lang, source, d.tokens, given // greatest(plan.tokens, 1) AS whole, given % greatest(plan.tokens, 1) AS rest, key
      FROM d JOIN plan USING (domain, lang, source)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '1', cast(whole AS VARCHAR), key))) AS upto FROM e)
SELECT doc_id, domain, lang, source, tokens, epoch FROM (
  SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM s)
"""


@query("op2_mixing", "", MIXING_SQL)
def op2(t):
    """Copies of documents that meet the target weights: up to four epochs, as many tokens as the corpus has."""
    found = Mixture(**TARGET, epochs=4).mix(t.documents)
    return found.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
                        F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"))


@query("op3_licence_scan", "")
def op3(t):
    """Licence families named in every document, with the number of paragraphs that name one."""
    found = LicenceScan().scan(t.documents)
    return found.select("doc_id", F.array_sort(F.array_distinct("spans.family")).alias("families"),
                        F.size("spans").cast("long").alias("n_paragraphs"), F.get("spans.start", F.lit(0)).alias("first_start"))


@query("op4_exact_dedup", "", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op4(t):
    """Every document's fate under exact deduplication through a fresh digest index."""
    found = ExactDedup().decisions(t.documents)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op5_html_extraction", "")
def op5(t):
    """Visible text of every page."""
    return visible_text(t.pages)


@query("op6_quality_rules", "")
def op6(t):
    """Base counts and divergence verdict of every document."""
    found = Divergence().judge(t.documents)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_chat_formatting", "")
def op7(t):
    """Every message with its reply link, its thread and its text without quotations."""
    return QuotationLinks().format(t.conversations)


@query("op8_packing", "")
def op8(t):
    """Best-fit decreasing packing of all documents into windows of 1,024 tokens."""
    return Packing(TOKENIZER).pieces(t.documents)


@query("op9_toxicity", "")
def op9(t):
    """Toxicity scores of all documents by a model trained on the labels outside fold 0."""
    model = toxicity.ToxicityTrainer().fit(t.documents, t.labels)
    found = toxicity.score(t.documents, model)
    return found.select("doc_id", (toxicity.fold_of("doc_id") == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_url_filter", "")
def op10(t):
    """Rule or link-graph verdict of every page's url."""
    return TrustFilter(RULES).judge(t.pages).select("page_id", "host", "path", "rule", "verdict")


@query("op11_embedding_whitening", "")
def op11(t):
    """Every embedding whitened along its first 32 components."""
    return Whitening().transform(t.embeddings)


MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
             greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", "", MIDDLE_SQL)
def op12(t):
    """Every document in fill-in-the-middle form, and the text that its output gives back."""
    fill = FillInMiddle()
    found = fill.transform(t.documents).withColumn("restored", fill.restored(F.col("output"), F.col("form")))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2("restored", 256).alias("restored_sha256"))


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                  min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p"""


@query("op13_warc_packages", "", WARC_SQL)
def op13(t):
    """Every page's record, read back from the packages that all pages were written to."""
    packages = WarcPackages()
    found = packages.read(packages.places(packages.write(t.pages)), payload=False)
    broken = F.raise_error(F.concat_ws(": ", "path", "problem"))
    kind = F.when(F.col("problem").isNotNull(), broken).otherwise(F.col("type"))
    return found.select(F.col("name").cast("long").alias("page_id"), "payload_bytes", "payload_digest", kind.alias("record_type"),
                        F.col("refers_to").cast("long").alias("refers_to"))

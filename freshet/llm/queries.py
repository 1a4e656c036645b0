"""Registered queries of the training-data operators, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.bpe import encode_decode
from freshet.llm.chat import format_chats
from freshet.llm.decontaminate import find_contamination
from freshet.llm.exact_dedup import exact_groups
from freshet.llm.filter_audit import audit_filters
from freshet.llm.near_dedup import near_groups
from freshet.llm.prefix_trie import conversation_trie
from freshet.llm.quality import classify_quality
from freshet.llm.substring_dedup import remove_repeats
from freshet.llm.suffix_dedup import remove_repeated_bytes
from freshet.llm.token_files import read_tokens, write_tokens
from freshet.llm.toxicity import classify_toxicity
from freshet.llm.warc import read_warc, resolved, write_warc
from freshet.session import scratch_dir

TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
         r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS n FROM p),
         c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE n > 1),
         x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
         k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """
)
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document, those that later windows repeat, and what is left."""
    out = remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    r"""
    WITH RECURSIVE
         d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g
               FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
         l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
         e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
         r(v, m) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.m FROM r JOIN e ON r.v = e.a WHERE r.m < e.b),
         c AS (SELECT v AS doc_id, min(m) AS component_id FROM r GROUP BY v)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """
)
def op2_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents that share most of their shingles."""
    return near_groups(table(spark, sf, "documents"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {15 - 5 * d}) % 32, 1)" for g in range(8) for d in range(4)
)


@query(
    f"""
    WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
         b AS (SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> f THEN f END AS refers_to FROM b
    """
)
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages to archives and back: each record with its payload's size and digest, and the original it refers to."""
    path = scratch_dir(spark, "warc")
    write_warc(table(spark, sf, "pages"), path, date="2024-01-31T12:00:00Z")
    return resolved(read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS l, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
         g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
               FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY l DESC, doc_id))
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """
)
def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    return exact_groups(table(spark, sf, "documents"))


@query(
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
         b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         i AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
         q AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM i),
         p AS (SELECT doc_id, w, z.n, unnest(range(1, len(w) - z.n + 2)) AS s FROM d, (SELECT DISTINCT n FROM q) z WHERE len(w) >= z.n),
         x AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM p),
         h AS (SELECT doc_id, x.n, s, item_id FROM x JOIN q ON x.g = q.g AND x.n = q.n),
         c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS j FROM h) GROUP BY doc_id),
         t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """
)
def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document lies in windows of benchmark items, and of which."""
    out = find_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizers are installed, which is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document and the text that they decode to."""
    return encode_decode(table(spark, sf, "documents"), tokenizer_path(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


@query()
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """The toxicity score of every document."""
    return classify_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of every conversation as repaired and rendered."""
    out = format_chats(table(spark, sf, "conversations"))
    return out.select("conv_id", "turn", "at", "role", "action", F.size("inserted").cast("long").alias("n_inserted"), "rendered", "cost")


@query()
def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of each document, those in passages that occur again, and what is left."""
    out = remove_repeated_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quality score of every document and whether it is kept."""
    return classify_quality(table(spark, sf, "documents"))


@query(
    r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         l AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
         f AS (SELECT t.part, coalesce(l.g, 0) AS g, coalesce(l.x, 0) AS tox, len(w) < 50 AS "A", 100 * len(list_distinct(w)) < 65 * len(w) AS "B",
                      100 * (length(t.x) - length(regexp_replace(t.x, '[A-Z]', '', 'g'))) > 5 * length(t.x) AS "C",
                      regexp_matches(t.x, '[#$%&*|]') AS "D", doc_id > min(doc_id) OVER (PARTITION BY t.x) AS "E" FROM t LEFT JOIN l USING (doc_id)),
         m AS (SELECT part, (CASE WHEN "A" THEN 'A' ELSE '' END) || (CASE WHEN "B" THEN 'B' ELSE '' END) || (CASE WHEN "C" THEN 'C' ELSE '' END)
                      || (CASE WHEN "D" THEN 'D' ELSE '' END) || (CASE WHEN "E" THEN 'E' ELSE '' END) AS fails, count(*) AS n, sum(g) AS g, sum(tox) AS t
               FROM f GROUP BY ALL),
         a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
         o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM a, a b, a c, a d, a e
               WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
         s AS (SELECT part, filter_order, step, filter_order[step] AS own, n, g, t, fails = filter_order[step] AS alone, contains(fails, filter_order[step]) AS hit,
                      fails <> '' AND translate(fails, filter_order[1:step - 1], '') <> fails AS gone
               FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
         r AS (SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN hit AND NOT gone THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN t ELSE 0 END) AS toxic_lost
               FROM s GROUP BY part, filter_order, step)
    SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM r
    """
)
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What five filters remove in every order, by source, and what each is worth."""
    return audit_filters(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("potential", "potential_without")


@query()
def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place among all token ids, their number and checksum, as read back from files."""
    path = scratch_dir(spark, "tokens")
    write_tokens(table(spark, sf, "documents"), path, tokenizer_path(WORD_TOKENIZER))
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(
    """
    WITH RECURSIVE
         crc AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) t(i)),
         tab AS (SELECT list(v ORDER BY i) AS t FROM crc),
         o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
         h AS (SELECT c, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                      lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) % 9 AS h
               FROM (SELECT c, count(*) AS n FROM o GROUP BY c), tab),
         k AS (SELECT h.c, h.n, h.h, least(h.h, coalesce(b.n, 0)) AS taken, h.c - h.c % 5 AS base FROM h LEFT JOIN h b ON b.c = h.c - h.c % 5),
         r AS (SELECT k.c, o.p AS d, o.role, o.text FROM k JOIN o ON o.c = k.base AND o.p <= k.taken
               UNION ALL SELECT k.c, o.p - k.h + k.taken, o.role, o.text FROM k JOIN o ON o.c = k.c AND o.p > k.h),
         s AS (SELECT c, d, text, list(length(role) || ':' || role || length(text) || ':' || text) OVER w AS path FROM r
               WINDOW w AS (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
         m AS (SELECT c, d, sha256(array_to_string(path, '')) AS node, strlen(text) AS bytes FROM s UNION ALL SELECT c, 0, '', 0 FROM k),
         x AS (SELECT c, max(d) AS last FROM m GROUP BY c),
         nd AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                       string_agg(CASE WHEN d = last THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM m JOIN x USING (c) GROUP BY d, node),
         up AS (SELECT nd.*, a.node AS pnode FROM nd LEFT JOIN m a ON a.c = nd.conv_id AND a.d = nd.d - 1),
         kids AS (SELECT d - 1 AS d, pnode AS node, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
         f AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (d, node)),
         -- every node to itself and all nodes above it: the prefixes of its smallest member
         sub AS (SELECT a.d, a.node, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
                 FROM f JOIN m a ON a.c = f.conv_id AND a.d <= f.d GROUP BY a.d, a.node)
    SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens,
           sha256(coalesce(f.ends, '')) AS ends_sha256
    FROM f JOIN sub USING (d, node) LEFT JOIN nd p ON p.d = f.d - 1 AND p.node = f.pnode
    """
)
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, with what sharing their turns saves."""
    return conversation_trie(table(spark, sf, "conversations"))


__all__ = ["ORACLES", "QUERIES"]

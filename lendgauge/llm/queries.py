"""The registered queries of this subpackage, each over its whole table, and their checking statements."""

import string

import public_tokenizers
from pyspark.sql import functions as F

from ..session import checkpointed, new_place
from . import bit_sliced, byte_bpe, chat, dart_minhash, exact_dedup, language, merkle, mixing, prefix_trie, suffix_array, super_kmers, tag_paths, winnowing
from .common import table
from .repeats import text_key

QUERIES = {}
STATEMENTS = {}


def query(name, statement=None):
    def register(function):
        QUERIES[name] = function
        if statement:
            STATEMENTS[name] = statement
        return function
    return register


def sha(text):
    return F.sha2(text.cast("binary"), 256)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, size, length(bin(size)) AS grade FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
counts AS (SELECT source, grade, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
sources AS (
  SELECT source, sum(words)::BIGINT AS source_size,
         1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM counts GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM sources WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         round(least(3.0 * source_size, coalesce(weight * first_value(CASE WHEN level * weight <= 3 * source_size THEN level END)
           OVER (ORDER BY CASE WHEN level * weight <= 3 * source_size THEN 0 ELSE 1 END, source_size / weight, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 3.0 * source_size)), 6) AS target
  FROM levels),
graded AS (
  SELECT c.source, c.grade, c.words, g.source_size, g.target,
         (g.target - 3 * coalesce(sum(words) OVER b, 0)) / nullif(sum(c.grade * words) OVER o - coalesce(sum(c.grade * words) OVER b, 0), 0) AS level
  FROM counts c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source
  WINDOW o AS (PARTITION BY c.source), b AS (PARTITION BY c.source ORDER BY c.grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
copies AS (
  SELECT *, round(least(3.0, coalesce(grade * max_by(level, grade) FILTER (level * grade <= 3) OVER (PARTITION BY source), 3.0)), 9) AS copies
  FROM graded),
cells AS (
  SELECT *, floor(copies)::BIGINT AS certain, copies - floor(copies) AS share,
         target - sum(floor(copies)::BIGINT * words) OVER (PARTITION BY source) AS rest FROM copies),
odds AS (
  SELECT s.*, c.source_size, c.target, c.certain, c.share, c.rest,
         (('0x' || substr(md5(concat_ws('|', '17', s.doc_id::VARCHAR, s.source, s.size::VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN cells c ON s.source IS NOT DISTINCT FROM c.source AND s.grade = c.grade),
ranked AS (
  SELECT *, CASE WHEN share > 0 AND size > 0 THEN (u / (1 - u)) / (share / (1 - share)) END AS q FROM odds),
running AS (
  SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST) AS reached FROM ranked)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (certain + CASE WHEN q IS NOT NULL AND (reached <= rest OR reached - rest < rest - (reached - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running"""


def sized_documents(docs):
    size = mixing.word_count(F.col("text"))
    return docs.withColumn("size", size).withColumn("grade", mixing.grade(F.col("size")))


@query("op1_pareto_mixing", MIX_SQL)
def op1(spark, folder):
    docs = table(spark, folder, "documents")
    # Counting words is the costly part: the slim rows are kept in the shared folder for the passes that follow.
    sized = checkpointed(sized_documents(docs).select("doc_id", "source", "size", "grade"))
    mixed = mixing.mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


RANKS = "byte_bpe_50k.tiktoken"


@query("op3_chunked_byte_bpe")
def op3(spark, folder):
    return byte_bpe.digests(table(spark, folder, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op4_language_profiles")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = language.held_out(F.col("doc_id"))
    prototypes = language.learn(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.identify(rows, prototypes).drop("text")


@query("op6_prefix_target_chat")
def op6(spark, folder):
    chats = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    back = chat.read_back(chat.examples(chats.unionByName(extra)))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(written).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


@query("op8_tag_path_ratios")
def op8(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return tag_paths.extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))


TOP_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, v FROM usable) q JOIN usable c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op5_bit_sliced_top", TOP_SQL)
def op5(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), bit_sliced.quantised(F.col("embedding")).alias("vector"))
    return bit_sliced.search(vectors.where(F.col("id") % 50 == 0), vectors, 5)


@query("op10_dart_minhash")
def op10(spark, folder):
    return dart_minhash.group(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def one_spaced(text):
    """Column: the words of a text, joined by one space."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


REPEATED_WORDS_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
cut AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM again),
cuts AS (SELECT r, list(i) AS gone FROM cut GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM words LEFT JOIN cuts USING (r)"""


@query("op9_super_kmer_dedup", REPEATED_WORDS_SQL)
def op9(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = super_kmers.verdicts(docs).select("key", "n_removed", sha(one_spaced(F.col("kept"))).alias("cut_sha256"))
    # Texts stay where they are: only digests meet the verdicts.
    slim = docs.select("doc_id", text_key(F.col("text")).alias("key"), mixing.word_count(F.col("text")).alias("n_words"), sha(one_spaced(text)).alias("sha256"))
    return slim.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))


@query("op7_winnowing")
def op7(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = winnowing.with_next(docs, {"grams": winnowing.selected(F.col("text"))})
    n = F.length("text")
    m = F.floor(n / 3).cast("int")
    edited = paired.withColumns({
        "n_chars": n, "__cut": n - m, "__taken": F.least(m, F.length("next_text")),
        "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next_text"), F.lit(1), m))})
    sets = edited.select(
        "doc_id", "n_chars", "edited", winnowing.hashes(F.col("grams")).alias("own"), winnowing.hashes(F.col("next_grams")).alias("next"),
        winnowing.spliced(F.col("grams"), F.col("__cut"), F.col("next_grams"), F.col("__taken"), F.col("edited")).alias("changed"))
    return sets.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), sha(F.col("edited")).alias("edited_sha256"),
        winnowing.digest(F.col("own")).alias("fingerprint"), winnowing.digest(F.col("changed")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("own"), F.col("changed")).alias("near_edited"), winnowing.likeness(F.col("own"), F.col("next")).alias("near_next"))


@query("op2_difference_cover_dedup")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = suffix_array.verdicts(docs).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    slim = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.octet_length(text).cast("bigint").alias("n_bytes"), sha(text).alias("sha256"))
    none = F.lit(0).cast("bigint")
    return slim.join(found, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"))


EQUAL_TEXTS_SQL = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
ranked AS (
  SELECT *, row_number() OVER o AS place, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM texts WINDOW o AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, text_sha256 FROM ranked"""


@query("op13_digest_index", EQUAL_TEXTS_SQL)
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    slim = checkpointed(exact_dedup.digests(docs))
    index = exact_dedup.DigestIndex.create(spark, new_place(spark, "digests"), exact_dedup.buckets_for(slim.count()))
    told = index.add(slim, "documents")
    return told.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def crc32_sql(text):
    """SQL for the unsigned CRC-32 of an ASCII string: every byte is followed by eight shifts."""
    bits = f"flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({text}, '')])"
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: {step}), 4294967295::BIGINT)"


def merkle_sql(levels=5):
    """Statement that hashes level by level; enough for 16 ** ``levels`` documents a source, and sources."""
    def climb(name, base, leaves):
        """Levels of the trees of one kind over ``base`` (t, i, h), and the way of ``leaves`` through them: siblings, and what ``f`` leads to."""
        parts = [f"{name}0 AS (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n FROM {base})",
                 f"{name}w0 AS (SELECT t, source_key, doc_id, h, subroot, i AS place, sib, f FROM {leaves})"]
        for d in range(levels):
            around = "array_to_string(b.hs[:a.place % 16], '')", "array_to_string(b.hs[a.place % 16 + 2:], '')"
            parts += [
                f"{name}r{d} AS (SELECT t, i // 16 AS i, list(h ORDER BY i) AS hs, max(n) AS n FROM {name}{d} GROUP BY t, i // 16)",
                f"{name}{d + 1} AS (SELECT t, i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h, (n + 15) // 16 AS n FROM {name}r{d})",
                f"""{name}w{d + 1} AS (
  SELECT a.t, a.source_key, a.doc_id, a.h, a.subroot, a.place // 16 AS place, a.sib || {around[0]} || {around[1]} AS sib,
    CASE WHEN b.n = 1 THEN a.f ELSE sha256({around[0]} || a.f || {around[1]}) END AS f
  FROM {name}w{d} a JOIN {name}r{d} b ON a.t = b.t AND a.place // 16 = b.i)"""]
        return ",\n".join(parts)

    def text(x):
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR END"

    fields = " || ".join(map(text, ("doc_id", "source", "lang", "n_chars")))
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH base AS (
  SELECT doc_id, coalesce('=' || source, '-') AS t, sha256({fields} || {text("text")}) AS h,
    CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256({fields} || {text(lowered)}) END AS changed FROM documents),
doc AS (SELECT t, t AS source_key, doc_id, h, '' AS subroot, '' AS sib, coalesce(changed, h) AS f,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM base),
{climb("s", "doc", "doc")},
sub AS (SELECT '' AS t, t AS source_key, h, row_number() OVER (ORDER BY t) - 1 AS i FROM s{levels}),
over_sub AS (SELECT b.t, a.source_key, a.doc_id, a.h, b.h AS subroot, a.sib, a.f, b.i FROM sw{levels} a JOIN sub b ON a.source_key = b.source_key),
{climb("r", "sub", "over_sub")}
SELECT a.doc_id, a.h AS leaf, a.subroot, b.h AS root, sha256(a.sib) AS proof_sha256, a.f AS folded_root, a.f = b.h AS verified
FROM rw{levels} a JOIN r{levels} b ON a.t = b.t"""


@query("op12_merkle_manifest", merkle_sql())
def op12(spark, folder):
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    rows = docs.select(
        merkle.tree_key(F.col("source")).alias("tree"), F.col("doc_id").alias("id"), merkle.leaf(*fields, F.col("text")).alias("digest"),
        F.when(tampered, merkle.leaf(*fields, lowered)).alias("changed"))
    made = merkle.manifest(rows.withColumn("shown", F.coalesce("changed", "digest")))
    root = F.lit(made.root).cast("string")
    return made.proofs().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


def trie_sql():
    """Statement with every beginning of every conversation as a key of its own."""
    return f"""
WITH turns AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
    strlen(coalesce(text, ''))::BIGINT AS b FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(b ORDER BY turn NULLS FIRST, k) AS bs FROM turns GROUP BY conv_id),
cut AS (SELECT *, {crc32_sql("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS base FROM own),
whole AS (
  SELECT a.conv_id, list_concat(coalesce(o.ks, [])[:a.h], a.ks[a.h + 1:]) AS ks, list_concat(coalesce(o.bs, [])[:a.h], a.bs[a.h + 1:]) AS bs
  FROM cut a LEFT JOIN own o ON o.conv_id = a.base),
places AS (SELECT conv_id, ks, bs, unnest(range(0, len(ks) + 1)) AS d FROM whole),
starts AS (
  SELECT conv_id, d, md5(array_to_string(ks[:d], '')) AS key, CASE WHEN d > 0 THEN md5(array_to_string(ks[:d - 1], '')) END AS parent,
    CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, len(ks) = d AS ends FROM places),
nodes AS (
  SELECT d, key, max(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS saved,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM starts GROUP BY d, key),
children AS (SELECT d - 1 AS d, parent AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.d = c.d AND n.key = c.key),
sums AS (
  SELECT s.d, s.key, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (n.n_children = 0)::BIGINT AS n_leaves
  FROM known n JOIN starts s ON s.conv_id = n.conv_id AND s.d <= n.d GROUP BY s.d, s.key)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens,
  n.ends_sha256
FROM known n JOIN sums s ON n.d = s.d AND n.key = s.key LEFT JOIN known p ON p.d = n.d - 1 AND p.key = n.parent"""


@query("op11_centroid_trie", trie_sql())
def op11(spark, folder):
    turns = prefix_trie.turn_lists(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))
    nodes = prefix_trie.trie(prefix_trie.with_shared_beginnings(turns))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))

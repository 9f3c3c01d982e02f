"""The queries of the catalogue as SQL for an independent engine, on the same tables."""

from __future__ import annotations

from corpusloom.operators.stopwords import FREQUENT_WORDS
from corpusloom.plans.queries import CLIP, ENCODER_DIM, LEMMAS, NGRAMS, WIDE_TOKENS

# The default function words, that is the English stop words that Spark ships.
FUNCTION_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these those
am is are was were be been being have has had having do does did doing a an the and but if or because
as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very s t can will just don
should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's
she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's
let's ought that's there's what's when's where's who's why's would
""".split()

WORD = r"[\p{L}\p{N}_]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items, *names: str) -> str:
    rows = ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in items)
    return f"SELECT * FROM (VALUES {rows}) AS v({', '.join(names)})"


def collapsed(column: str, ngrams=NGRAMS) -> str:
    for ngram in ngrams:
        column = f"replace({column}, {text(ngram)}, {text(ngram.replace(' ', '_'))})"
    return column


def joined(column: str, ngrams) -> str:
    for ngram in ngrams:
        left, right = ngram.split()
        column = (
            rf"regexp_replace({column}, '(?i)(^|[^\p{{L}}\p{{N}}_])({left})\s+({right})', '\1\2_\3', 'g')"
        )
    return column


TWO_PARTS = [g for g in NGRAMS if g.count(" ") == 1]
N_DOCS = "(SELECT count(*) FROM documents)"
N_STATS = "(SELECT count(DISTINCT id) FROM article_stats)"
KINDS = ["frequency", "tfidf", "ridf", "ensemble"]
HEX = "strpos('0123456789abcdef', substr(h, {}, 1)) - 1"


def stats_sql(source: str) -> str:
    return f"""SELECT id, token, n, n / sum(n) OVER (PARTITION BY id) AS tf FROM (
        SELECT id, token, count(*) AS n FROM {source}
        WHERE length(token) >= 3 AND token NOT IN (SELECT word FROM stop) GROUP BY id, token)"""


def pooled(source: str) -> str:
    """Entries of the hash encoder's article vectors for (id, text)."""
    d = ENCODER_DIM
    entry = f"(16 * ({HEX.format('2 * k + 1')}) + {HEX.format('2 * k + 2')}) / 255.0"
    return f"""
    sents AS (SELECT id, s, unnest(s) AS sentence, generate_subscripts(s, 1) AS sent FROM (
        SELECT id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM {source})),
    pieces AS (SELECT id, sent, list_filter(string_split(sentence, ' '), lambda t: t <> '') AS w FROM sents),
    hashed AS (SELECT id, sent, md5(unnest(w)) AS h FROM pieces),
    dims AS (SELECT range AS k FROM range({d})),
    sent_means AS (SELECT id, sent, k, avg(CAST({entry} AS DOUBLE)) AS v FROM hashed, dims GROUP BY id, sent, k),
    encoded AS (SELECT id AS article_id, CAST(k AS INTEGER) AS dim, round(avg(coalesce(v, 0.0)), 6) AS value
        FROM pieces CROSS JOIN dims LEFT JOIN sent_means USING (id, sent, k) GROUP BY id, k)"""


# name -> (SQL, names it uses)
PARTS: dict[str, tuple[str, str]] = {
    "articles": (
        """SELECT doc_id AS id, split_part(text, chr(10), 1) AS title,
        substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
        lpad(CAST(doc_id // 100 + 1 AS VARCHAR), 4, '0') AS batch FROM documents""", ""),
    "gaps": (
        """SELECT id, CASE WHEN contains(title, ' ') THEN title END AS title,
        nullif(abstract, '') AS abstract, batch FROM articles""", "articles"),
    "texts": ("SELECT id, batch, lower(title || ' ' || abstract) AS text FROM articles", "articles"),
    "stop": (
        f"""SELECT DISTINCT word FROM (
        SELECT unnest([{', '.join(text(w) for w in FUNCTION_WORDS + FREQUENT_WORDS)}]) AS word
        UNION ALL SELECT lpad(CAST(range AS VARCHAR), CAST(greatest(2, length(CAST(range AS VARCHAR))) AS INTEGER), '0') FROM range(101)
        UNION ALL SELECT CAST(range AS VARCHAR) FROM range(10)
        UNION ALL SELECT chr(CAST(range AS INTEGER)) FROM range(97, 123)
        UNION ALL SELECT CAST(range AS VARCHAR) FROM range(2000, 2030))""", ""),
    "tokens": (f"SELECT id, batch, unnest(regexp_extract_all(text, '{WORD}+')) AS token FROM texts", "texts"),
    "used": ("SELECT token, count(*) AS n FROM tokens GROUP BY token", "tokens"),
    "article_stats": (stats_sql("tokens"), "tokens stop"),
    "totals": (
        """SELECT token, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CAST(floor(tf * 1073741824.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 1073741824.0::DOUBLE +
        CAST(sum(CAST(floor((tf * 1073741824.0::DOUBLE - floor(tf * 1073741824.0::DOUBLE)) * 1073741824.0::DOUBLE) AS BIGINT)) AS DOUBLE)
        / 1152921504606846976.0::DOUBLE AS tf, count(*) AS num_articles FROM article_stats GROUP BY token""",
        "article_stats"),
    "scored": (
        """SELECT *, ln((1 + na) / (1 + num_articles)) AS idf, tf * ln((1 + na) / (1 + num_articles)) / na AS mean_tfidf,
        log2(na / num_articles) + log2(1 - exp(-n / na)) AS ridf
        FROM (SELECT *, CAST((SELECT count(DISTINCT id) FROM article_stats) AS DOUBLE) AS na FROM totals)""", "totals"),
    "weighed": (
        """SELECT *, (ridf + abs(lo)) / (hi + abs(lo)) AS scaled,
        (ridf + abs(lo)) / (hi + abs(lo)) * ln(num_articles + 1) / ml AS w
        FROM scored, (SELECT min(ridf) AS lo, max(ridf) AS hi, ln(max(num_articles) + 1) AS ml FROM scored)""", "scored"),
    "token_stats": (
        """SELECT token, n, tf, num_articles, idf, mean_tfidf, ridf, w / (SELECT max(w) FROM weighed) AS adj_ridf
        FROM weighed""", "weighed"),
    "targets": (f"SELECT token FROM totals WHERE n >= {N_DOCS} // 10", "totals"),
    "presence": ("SELECT DISTINCT id, token FROM article_stats JOIN targets USING (token)", "article_stats targets"),
    "pair_counts": (
        """SELECT a.token AS token1, b.token AS token2, count(*) AS k FROM presence a JOIN presence b
        ON a.id = b.id AND a.token < b.token GROUP BY a.token, b.token""", "presence"),
    "singles": ("SELECT token, count(*) AS c FROM presence GROUP BY token", "presence"),
    "correlations": (
        """SELECT token1, token2, (m * k - a.c * b.c) / nullif(sqrt(CAST(a.c * (m - a.c) AS DOUBLE)) *
        sqrt(CAST(b.c * (m - b.c) AS DOUBLE)), 0) AS cor
        FROM pair_counts JOIN singles a ON a.token = token1 JOIN singles b ON b.token = token2,
        (SELECT count(DISTINCT id) AS m FROM presence)""", "pair_counts singles"),
    "pairs": ("SELECT * FROM correlations WHERE cor >= 0.5", "correlations"),
    "candidates": (
        """SELECT DISTINCT ngram FROM (SELECT token1 || ' ' || token2 AS ngram FROM pairs
        UNION ALL SELECT token2 || ' ' || token1 FROM pairs)""", "pairs"),
    "hits": ("SELECT id, batch, ngram FROM texts JOIN candidates ON contains(text, ngram)", "texts candidates"),
    "ngram_counts": (
        """SELECT ngram, coalesce(freq, 0) AS freq FROM candidates LEFT JOIN
        (SELECT ngram, count(*) AS freq FROM hits GROUP BY ngram) USING (ngram)""", "hits candidates"),
    "known": (values(list(enumerate(NGRAMS)), "pos", "ngram"), ""),
    "vocab_tokens": (
        f"SELECT * FROM token_stats WHERE num_articles BETWEEN 0.01 * {N_DOCS} AND 0.5 * {N_DOCS}", "token_stats"),
    "ranks": (
        """SELECT *, row_number() OVER (ORDER BY n DESC, token) AS n_rank,
        row_number() OVER (ORDER BY mean_tfidf DESC, token) AS tfidf_rank,
        row_number() OVER (ORDER BY adj_ridf DESC, token) AS ridf_rank FROM vocab_tokens""", "vocab_tokens"),
    "vocab": (
        """SELECT 'frequency' AS embedding, token, CAST(n_rank AS INTEGER) AS rank FROM ranks WHERE n_rank <= 64
        UNION ALL SELECT 'tfidf', token, tfidf_rank FROM ranks WHERE tfidf_rank <= 64
        UNION ALL SELECT 'ridf', token, ridf_rank FROM ranks WHERE ridf_rank <= 64
        UNION ALL SELECT * FROM (SELECT 'ensemble', token,
            row_number() OVER (ORDER BY least(tfidf_rank, ridf_rank), token) AS r FROM ranks) WHERE r <= 64""", "ranks"),
    "counts": (
        """SELECT embedding, id AS article_id, CAST(rank - 1 AS INTEGER) AS dim, n
        FROM article_stats JOIN vocab USING (token)""", "article_stats vocab"),
    "all_kinds": (f"SELECT id AS article_id, unnest({KINDS}) AS embedding FROM articles", "articles"),
    "emb": (
        "SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings", ""),
    "flat": (
        """SELECT article_id, label, CASE WHEN label = 0 THEN list_transform(embedding, lambda x: embedding[1])
        ELSE embedding END AS embedding FROM emb""", "emb"),
    "repeated": (
        """SELECT article_id, embedding, 1 AS version FROM emb
        UNION ALL SELECT article_id, list_transform(embedding, lambda v: v * 2), 2 FROM emb WHERE label = 1""", "emb"),
    "points": ("SELECT article_id, embedding[1] AS x1, embedding[2] AS x2 FROM emb", "emb"),
    "clusters": (
        "SELECT article_id, 'cluster_' || lpad(CAST(label AS VARCHAR), 2, '0') AS cluster FROM emb", "emb"),
    "clustered": ("SELECT * FROM points JOIN clusters USING (article_id)", "points clusters"),
    "bounds": (
        f"""SELECT quantile_cont(x1, {1 - CLIP}) AS min_x, quantile_cont(x1, {CLIP}) AS max_x,
        quantile_cont(x2, {1 - CLIP}) AS min_y, quantile_cont(x2, {CLIP}) AS max_y FROM picture""", "picture"),
    "picture": ("SELECT * FROM clustered", "clustered"),
    "raster": (
        """SELECT CAST(least(floor((x1 - min_x) * 50 / (max_x - min_x)), 49) AS INTEGER) AS px,
        CAST(least(floor((x2 - min_y) * 50 / (max_y - min_y)), 49) AS INTEGER) AS py, cluster, count(*) AS n
        FROM picture, bounds WHERE x1 BETWEEN min_x AND max_x AND x2 BETWEEN min_y AND max_y GROUP BY ALL""",
        "picture bounds"),
    "palette": (
        """SELECT cluster, colour, CAST(('0x' || substr(colour, 2, 2)) AS INTEGER) AS r,
        CAST(('0x' || substr(colour, 4, 2)) AS INTEGER) AS g, CAST(('0x' || substr(colour, 6, 2)) AS INTEGER) AS b FROM (
        SELECT cluster, (CASE WHEN count(*) OVER () <= 10 THEN
        ['#fc8e61', '#ffadad', '#ffd6a5', '#caffbf', '#84d879', '#40e6b9', '#9bf6ff', '#a0c4ff', '#bdb2ff', '#ffc6ff']
        ELSE ['#3d358b', '#4456c7', '#4776ee', '#4294ff', '#2fb2f4', '#1bd0d5', '#1ae4b6', '#35f394', '#61fc6c',
        '#8fff49', '#b4f836', '#d2e935', '#ebd339', '#faba39', '#fe9b2d', '#f9751d', '#ec530f', '#da3907', '#c12302',
        '#a11201'] END)[row_number() OVER (ORDER BY cluster)] AS colour
        FROM (SELECT DISTINCT cluster FROM clusters))""", "clusters"),
    "pixels": (
        """SELECT px, py, sum(n) AS total, sum(n * r) / sum(n) AS r, sum(n * g) / sum(n) AS g, sum(n * b) / sum(n) AS b
        FROM raster JOIN palette USING (cluster) GROUP BY px, py""", "raster palette"),
    "shaded": (
        """SELECT px, py, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b,
        round(cume_dist() OVER (ORDER BY total), 6) AS alpha FROM pixels""", "pixels"),
    "token_vectors": (
        """SELECT article_id // 25 AS article_id, CAST(article_id // 5 AS INTEGER) AS sent,
        CAST(article_id % 7 <> 0 AS INTEGER) AS mask, embedding AS vec FROM emb""", "emb"),
    "sentence_means": (
        """SELECT article_id, sent, dim, sum(v * mask) / greatest(sum(mask), 1e-9) AS value FROM (
        SELECT article_id, sent, mask, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM token_vectors)
        GROUP BY article_id, sent, dim""", "token_vectors"),
}


def near(source: str, distance: str, k: int = 5) -> str:
    return f"""SELECT article_id, neighbour, CAST(rank AS INTEGER) AS rank, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY distance, neighbour) AS rank FROM (
        SELECT a.article_id, b.article_id AS neighbour, round(greatest({distance}, 0), 9) AS distance
        FROM {source} a JOIN {source} b ON a.article_id <> b.article_id)) WHERE rank <= {k}"""


COSINE = "1 - list_cosine_similarity(a.embedding, b.embedding)"
PARTS["near"] = (near("emb", COSINE), "emb")


def with_parts(names: str, body: str, extra: str = "") -> str:
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for needed in PARTS[name][1].split():
                add(needed)
            done.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{name} AS ({PARTS[name][0]})" for name in done] + ([extra] if extra else [])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


ORACLES: dict[str, str] = {}


def oracle(name: str, names: str, body: str, extra: str = "") -> None:
    ORACLES[name] = with_parts(names, body, extra)


A_CHARS = "CAST(length(abstract) AS INTEGER) AS abstract_chars"
oracle("s01_batch_scan", "articles", f"SELECT id, title, {A_CHARS}, batch FROM articles WHERE batch BETWEEN '0003' AND '0007'")
oracle("s02_corpus_scan", "articles", f"SELECT id, title, {A_CHARS} FROM articles")
oracle("s03_processing_choice", "articles", "SELECT id, lower(title) AS title FROM articles")
oracle("s04_feather_source", "articles", f"SELECT id, title, {A_CHARS}, batch FROM articles")
oracle("s05_parquet_source", "", "SELECT doc_id, lang, n_chars FROM documents")
oracle("s06_ngram_list", "articles", """SELECT CAST(row_number() OVER (ORDER BY ngram) - 1 AS INTEGER) AS pos, ngram
    FROM (SELECT DISTINCT lower(title) AS ngram FROM articles WHERE contains(title, ' '))""")
oracle("s07_count_source", "all_kinds counts", """SELECT article_id, embedding, coalesce(s, 0) AS n FROM all_kinds
    LEFT JOIN (SELECT article_id, embedding, CAST(sum(n) AS BIGINT) AS s FROM counts GROUP BY ALL) USING (article_id, embedding)""")
STATS = "SELECT id, token, n, round(tf, 6) AS tf FROM article_stats"
oracle("s08_parquet_sink", "article_stats", STATS)
BATCH_STATS = """SELECT batch, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM article_stats JOIN articles USING (id) GROUP BY batch"""
oracle("s09_append_sink", "article_stats articles", BATCH_STATS)
oracle("s10_feather_sink", "totals", "SELECT token, n, num_articles FROM totals")
oracle("s11_text_sink", "articles", "SELECT CAST(id AS VARCHAR) AS article_id FROM articles")
oracle("s12_count_sink", "counts", "SELECT embedding, article_id, dim, n FROM counts")
oracle("s13_require_rows", "articles", "SELECT batch, count(*) AS rows FROM articles GROUP BY batch")

oracle("p01_article_text", "articles", """SELECT id, title, md5(abstract) AS abstract,
    md5(title || ' ' || abstract) AS "both" FROM articles""")
oracle("p02_lowercase", "texts", "SELECT id, md5(text) AS text FROM texts")
oracle("p03_null_to_empty", "gaps", """SELECT id, coalesce(title, '') AS title,
    CAST(length(coalesce(abstract, '')) AS INTEGER) AS abstract_chars FROM gaps""")
oracle("p04_exclude_articles", "gaps", """SELECT a.flag AS abstract, t.flag AS title, id FROM gaps,
    (VALUES (true), (false)) a(flag), (VALUES (true), (false)) t(flag)
    WHERE (NOT a.flag OR gaps.abstract IS NOT NULL) AND (NOT t.flag OR gaps.title IS NOT NULL)""")
oracle("p05_encoder_text", "gaps", """SELECT id,
    md5(replace(coalesce(title, '') || ' ' || coalesce(abstract, ''), chr(10), ' ')) AS text FROM gaps""")
oracle("p06_collapse_ngrams", "texts", f"""SELECT id, md5(c) AS text,
    CAST(length(c) - length(replace(c, '_', '')) AS INTEGER) AS marks
    FROM (SELECT id, {collapsed('text')} AS c FROM texts)""")
oracle("p07_tokens", "texts", f"""SELECT id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens
    FROM (SELECT id, regexp_extract_all(text, '{WORD}+') AS w FROM texts)""")
oracle("p08_stop_words", "used stop", "SELECT token, n FROM used WHERE token NOT IN (SELECT word FROM stop)")
oracle("p09_min_length", "used", "SELECT token, n FROM used WHERE length(token) >= 5")
USE = "SELECT word, coalesce(n, 0) AS n FROM {} LEFT JOIN used ON token = word"
oracle("p10_stop_list", "used stop", USE.format("stop"))
oracle("p11_lemmatized_stop_list", "used stop", USE.format("lemmatized"), f"""lemmas AS ({values(LEMMAS, 'word', 'lemma')}),
    lemmatized AS (SELECT coalesce(lemma, word) AS word FROM stop LEFT JOIN lemmas USING (word) UNION SELECT 'https')""")
oracle("p12_min_frequency", "targets", "SELECT token FROM targets")
oracle("p13_document_ratio", "totals", f"""SELECT token, num_articles FROM totals
    WHERE num_articles >= 0.01 * {N_DOCS} AND num_articles <= 0.5 * {N_DOCS}""")
oracle("p14_min_correlation", "correlations", "SELECT token1, token2, round(cor, 6) AS cor FROM correlations WHERE cor >= 0.15")
oracle("p15_ngram_frequency", "ngram_counts", f"SELECT ngram, freq FROM ngram_counts WHERE freq >= {N_DOCS} // 100")
oracle("p16_zero_variance", "flat", "SELECT article_id, label FROM flat WHERE list_var_pop(embedding) > 1e-20")
BOX = "x1 BETWEEN min_x AND max_x AND x2 BETWEEN min_y AND max_y"
oracle("p17_clip", "points bounds", f"""SELECT article_id, round(x1, 6) AS x1, round(x2, 6) AS x2 FROM points, bounds WHERE {BOX}""")
oracle("p18_column_pruning", "article_stats", "SELECT id, count(*) AS tokens FROM article_stats GROUP BY id")
oracle("p19_id_cast", "article_stats", "SELECT id, CAST(sum(n) AS BIGINT) AS n FROM article_stats GROUP BY id")
oracle("p20_dictionary", "totals", "SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS code FROM totals")
oracle("p21_replace_ngrams", "articles", f"""SELECT id, md5(t) AS title, md5(a) AS abstract,
    CAST(length(a) - length(replace(a, '_', '')) AS INTEGER) AS marks
    FROM (SELECT id, {joined('title', TWO_PARTS)} AS t, {joined('abstract', TWO_PARTS)} AS a FROM articles)""")
oracle("p22_sentences", "articles", """SELECT id, sent, CAST(length(sentence) AS INTEGER) AS chars, md5(sentence) AS sentence FROM (
    SELECT id, unnest(s) AS sentence, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent FROM (
    SELECT id, string_split(regexp_replace(replace(title || ' ' || abstract, chr(10), ' '), '([.!?])\\s+',
    '\\1' || chr(1), 'g'), chr(1)) AS s FROM articles))""")
oracle("p23_rename", "emb", """SELECT article_id, round(embedding[64], 6) AS dim_63, round(embedding[1], 6) AS dim_0 FROM emb""")
LABEL = "'cluster_' || lpad(CAST(label AS VARCHAR), {}, '0') AS cluster{}"
oracle("p24_cluster_label", "emb", "SELECT article_id, " + ", ".join(
    LABEL.format(w, k) for k, w in ((9, 1), (10, 2), (99, 2), (100, 3))) + " FROM emb")

oracle("j01_semi_join_tokens", "article_stats targets", "SELECT id, token FROM article_stats WHERE token IN (SELECT token FROM targets)")
SAMPLED = f"(SELECT id FROM articles ORDER BY md5('321-' || id), id LIMIT {N_DOCS} // 2)"
oracle("j02_semi_join_articles", "article_stats articles", f"SELECT id, token FROM article_stats WHERE id IN {SAMPLED}")
oracle("j03_with_idf", "article_stats token_stats", """SELECT id, token, a.n, round(a.tf, 6) AS tf, round(idf, 6) AS idf
    FROM article_stats a JOIN token_stats USING (token)""")
oracle("j04_match_ngrams", "hits", "SELECT id, ngram FROM hits")
oracle("j05_token_pairs", "pair_counts", "SELECT token1, token2, k FROM pair_counts")
oracle("j06_vocab_counts", "counts", "SELECT embedding, article_id, dim, n FROM counts")
oracle("j07_ids_with_rows", "emb", "SELECT article_id, round(list_sum(embedding), 6) AS total FROM emb")
oracle("j08_with_cluster", "clustered", "SELECT article_id, round(x1, 6) AS x1, round(x2, 6) AS x2, cluster FROM clustered")
oracle("j09_add_counts", "ngram_counts", "SELECT ngram, freq FROM ngram_counts")
oracle("j10_zip_ranked", "vocab", "SELECT rank, " + ", ".join(
    f"max(token) FILTER (embedding = '{k}') AS {k}" for k in KINDS) + """ FROM
    (SELECT CAST(range AS INTEGER) AS rank FROM range(1, 65)) LEFT JOIN vocab USING (rank) GROUP BY rank""")

COUNTED = "counted AS (SELECT id, token, count(*) AS n FROM tokens GROUP BY id, token)"
oracle("a01_count_tokens", "tokens", "SELECT id, token, n FROM counted", COUNTED)
oracle("a02_article_totals", "tokens", "SELECT id, count(*) AS num_tokens FROM tokens GROUP BY id")
oracle("a03_term_frequency", "tokens", """SELECT id, token, n, CAST(sum(n) OVER (PARTITION BY id) AS BIGINT) AS num_tokens,
    round(n / sum(n) OVER (PARTITION BY id), 6) AS tf FROM counted""", COUNTED)
oracle("a04_num_articles", "article_stats", f"SELECT {N_STATS} AS n_articles")
oracle("a05_token_totals", "totals", "SELECT token, n, round(tf, 6) AS tf FROM totals")
oracle("a06_document_frequency", "totals", "SELECT token, num_articles FROM totals")
oracle("a07_mean_tfidf", "article_stats scored", f"""SELECT token, round(sum(a.tf * idf) / {N_STATS}, 6) AS mean_tfidf
    FROM article_stats a JOIN scored USING (token) GROUP BY token""")
oracle("a08_minmax", "scored", "SELECT round(min(ridf), 6) AS min, round(max(ridf), 6) AS max FROM scored")
oracle("a09_presence_wide", "article_stats", "SELECT id, " + ", ".join(
    f"bool_or(token = '{t}') AS \"{t}\"" for t in sorted(WIDE_TOKENS))
    + f" FROM article_stats WHERE token IN ({', '.join(text(t) for t in WIDE_TOKENS)}) GROUP BY id")
oracle("a10_pair_correlation", "correlations", "SELECT token1, token2, round(cor, 6) AS cor FROM correlations")
oracle("a11_ngram_document_frequency", "ngram_counts", "SELECT ngram, freq FROM ngram_counts")
oracle("a12_ngram_totals", "hits", "SELECT ngram, count(*) AS freq FROM hits GROUP BY ngram")
oracle("a13_missed_articles", "all_kinds counts", """SELECT embedding, count(*) FILTER (n IS NULL) AS missed FROM all_kinds
    LEFT JOIN (SELECT embedding, article_id, sum(n) AS n FROM counts GROUP BY ALL) USING (embedding, article_id)
    GROUP BY embedding""")
oracle("a14_corpus_size", "articles", "SELECT count(*) AS n_articles FROM articles")
oracle("a15_pool_sentences", "sentence_means", """SELECT article_id, sent, CAST(dim AS INTEGER) AS dim,
    round(value, 6) AS value FROM sentence_means""")
oracle("a16_pool_articles", "sentence_means", """SELECT article_id, CAST(dim AS INTEGER) AS dim,
    round(avg(value), 6) AS value FROM sentence_means GROUP BY article_id, dim""")
oracle("a17_quantiles", "bounds", """SELECT round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(min_y, 6) AS min_y,
    round(max_y, 6) AS max_y FROM bounds""")
oracle("a18_bin_points", "raster", "SELECT px, py, cluster, n FROM raster")
oracle("a19_cluster_limit", "clusters", "SELECT count(DISTINCT cluster) AS n_clusters FROM clusters")
oracle("a20_duplicate_report", "repeated", "SELECT count(*) AS n_before, count(DISTINCT article_id) AS n_after FROM repeated")
oracle("a21_zero_variance_report", "flat", """SELECT count(*) AS n_constant FROM flat
    WHERE list_max(embedding) = list_min(embedding)""")
oracle("a22_unique_key", "repeated", "SELECT article_id, count(*) AS n FROM repeated GROUP BY article_id HAVING count(*) > 1")
oracle("a23_two_level", "totals", "SELECT token, n, num_articles FROM totals")

for name, rank in (("w01_tfidf_rank", "tfidf_rank"), ("w02_ridf_rank", "ridf_rank")):
    oracle(name, "ranks", f"SELECT token, {rank} FROM ranks")
oracle("w03_min_rank", "ranks", "SELECT token, least(tfidf_rank, ridf_rank) AS min_rank FROM ranks")
oracle("w04_keep_last", "repeated", """SELECT article_id, version, round(embedding[1], 6) AS first FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY version DESC) AS r FROM repeated) WHERE r = 1""")
oracle("w05_equalize", "raster", """SELECT px, py, total, round(cume_dist() OVER (ORDER BY total), 6) AS shade
    FROM (SELECT px, py, CAST(sum(n) AS BIGINT) AS total FROM raster GROUP BY px, py)""")

oracle("t01_sort_tokens", "totals", "SELECT token, n, num_articles FROM totals ORDER BY n DESC, token")
for name, rank in (("t02_top_frequency", "n_rank"), ("t03_top_tfidf", "tfidf_rank"), ("t04_top_ridf", "ridf_rank")):
    oracle(name, "ranks", f"SELECT CAST({rank} AS INTEGER) AS rank, token FROM ranks WHERE {rank} <= 64")
oracle("t05_top_ensemble", "vocab", "SELECT CAST(rank AS INTEGER) AS rank, token FROM vocab WHERE embedding = 'ensemble'")
SIZE = "CAST(length(ngram) - length(replace(ngram, ' ', '')) AS INTEGER) AS size"
oracle("t06_order_ngrams", "candidates known", f"""SELECT ngram, {SIZE} FROM
    (SELECT ngram FROM candidates UNION SELECT ngram FROM known)""")
oracle("t07_sorted_candidates", "candidates", "SELECT ngram FROM candidates ORDER BY ngram")
oracle("t08_ngrams_by_frequency", "ngram_counts", "SELECT ngram, freq FROM ngram_counts ORDER BY freq DESC, ngram")
oracle("t09_tokens_in_order", "article_stats", "SELECT id, token, n FROM article_stats")
oracle("t10_sample_articles", "articles", f"SELECT id, batch FROM articles WHERE id IN {SAMPLED}")

oracle("u01_union_batches", "article_stats", STATS)
oracle("u02_token_set", "totals", "SELECT token FROM totals")
oracle("u03_union_embeddings", "repeated", "SELECT article_id, version, round(embedding[1], 6) AS first FROM repeated")
oracle("u04_extend_ngrams", "ngram_counts known", f"""SELECT ngram FROM ngram_counts WHERE freq >= {N_DOCS} // 100
    UNION SELECT ngram FROM known""")
oracle("u05_ngram_candidates", "candidates", "SELECT ngram FROM candidates")
FULL = """SELECT a.token AS token1, b.token AS token2, round((m * coalesce(k, 0) - a.c * b.c) /
    nullif(sqrt(CAST(a.c * (m - a.c) AS DOUBLE)) * sqrt(CAST(b.c * (m - b.c) AS DOUBLE)), 0), 6) AS cor
    FROM singles a JOIN singles b ON a.token < b.token
    LEFT JOIN pair_counts ON token1 = a.token AND token2 = b.token, (SELECT count(DISTINCT id) AS m FROM presence)"""
oracle("u06_upper_triangle", "singles pair_counts", FULL)

oracle("m01_idf", "scored", "SELECT token, round(idf, 6) AS idf FROM scored")
oracle("m02_tfidf", "article_stats scored", """SELECT id, token, round(a.tf * idf, 6) AS tfidf
    FROM article_stats a JOIN scored USING (token)""")
oracle("m03_ridf", "scored", "SELECT token, round(ridf, 6) AS ridf FROM scored")
oracle("m04_scaled_ridf", "weighed", "SELECT token, round(scaled, 6) AS scaled FROM weighed")
oracle("m05_adj_ridf", "token_stats", "SELECT token, round(adj_ridf, 6) AS adj_ridf FROM token_stats")
oracle("m06_phi", "correlations", "SELECT token1, token2, round(cor, 6) AS cor FROM correlations")
oracle("m07_string_functions", "texts", """SELECT id, contains(text, 'der ein') AS found,
    md5(replace(text, 'der ein', 'der_ein')) AS replaced,
    CAST(length(text) - length(replace(text, ' ', '')) AS INTEGER) AS spaces,
    CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INTEGER) AS parts FROM texts""")
oracle("m08_zero_pad", "articles", "SELECT id, " + ", ".join(
    f"lpad(CAST(id AS VARCHAR), CAST(greatest({w}, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS pad{w}" for w in (2, 4)) + " FROM articles")
oracle("m09_palette", "palette", "SELECT cluster, colour, r, g, b FROM palette")
oracle("m10_shade", "shaded", "SELECT px, py, r, g, b, alpha FROM shaded")

oracle("v01_count_embedding", "all_kinds counts", """SELECT embedding, article_id, coalesce(s, 0) AS total,
    coalesce(t, 0) AS tokens FROM all_kinds LEFT JOIN (SELECT embedding, article_id, CAST(sum(n) AS BIGINT) AS s, count(*) AS t
    FROM counts GROUP BY ALL) USING (embedding, article_id)""")
oracle("v03_assign_clusters", "emb", """SELECT article_id, cluster FROM (SELECT article_id, cluster,
    row_number() OVER (PARTITION BY article_id ORDER BY round(list_distance(embedding, c), 9), cluster) AS r
    FROM emb, centres) WHERE r = 1""", """centres AS (SELECT label AS cluster, list(m ORDER BY k) AS c FROM (
    SELECT label, k, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k
    FROM emb) GROUP BY label, k) GROUP BY label)""")
oracle("v04_encode", "articles", "SELECT * FROM encoded",
       "src AS (SELECT id, replace(title || ' ' || abstract, chr(10), ' ') AS text FROM articles)," + pooled("src"))
oracle("v06_knn", "near", "SELECT article_id, neighbour, rank, distance FROM near")
oracle("v07_neighbour_weights", "near", """SELECT article1, article2, round(sum(w) - CASE WHEN count(*) > 1
    THEN max(w) * min(w) ELSE 0 END, 6) AS weight FROM (
    SELECT least(article_id, neighbour) AS article1, greatest(article_id, neighbour) AS article2,
    exp(-greatest(distance - rho, 0) / greatest(mid, 1e-3 * list_avg(d), 1e-12)) AS w
    FROM near JOIN search USING (article_id) WHERE step = 64) GROUP BY article1, article2""", """
    lists AS (SELECT article_id, list(distance ORDER BY distance) AS d,
        coalesce(min(distance) FILTER (distance > 0), 0) AS rho FROM near GROUP BY article_id),
    search AS (SELECT article_id, d, rho, 0 AS step, 0.0::DOUBLE AS low, -1.0::DOUBLE AS high, 1.0::DOUBLE AS mid FROM lists
        UNION ALL SELECT article_id, d, rho, step + 1, CASE WHEN wide THEN low ELSE mid END,
        CASE WHEN wide THEN mid ELSE high END,
        CASE WHEN wide THEN (low + mid) / 2 WHEN high < 0 THEN mid * 2 ELSE (mid + high) / 2 END FROM (
        SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) > log2(len(d)) AS wide
        FROM search WHERE step < 64))""")


def small_picture(name: str, rows: str) -> None:
    kept = PARTS["picture"]
    PARTS["picture"] = (rows, "clustered")
    oracle(name, "shaded", "SELECT px, py, r, g, b, alpha FROM shaded")
    PARTS["picture"] = kept


small_picture("v08_rasterize", "SELECT * FROM clustered")
small_picture("r15_visualize", "SELECT * FROM clustered")

PARTS["joined_tokens"] = (f"SELECT id, unnest(regexp_extract_all({collapsed('text')}, '{WORD}+')) AS token FROM texts", "texts")
oracle("r01_article_stats", "joined_tokens stop", f"SELECT id, token, n, round(tf, 6) AS tf FROM ({stats_sql('joined_tokens')})")
oracle("r02_combine_article_stats", "article_stats", """SELECT id, token, dense_rank() OVER (ORDER BY token) - 1 AS code, n,
    round(tf, 6) AS tf FROM article_stats""")
STAT_COLUMNS = ["tf", "idf", "mean_tfidf", "ridf", "adj_ridf"]
oracle("r03_token_stats", "token_stats", "SELECT token, n, num_articles, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in STAT_COLUMNS) + " FROM token_stats")
oracle("r04_token_cooccurrence", "presence", "SELECT DISTINCT id, token FROM presence")
oracle("r05_token_correlations", "singles pair_counts", FULL)
oracle("r06_correlated_token_pairs", "pairs", "SELECT token1, token2, round(cor, 6) AS cor FROM pairs")
oracle("r07_detect_ngrams", "ngram_counts", "SELECT ngram, freq FROM ngram_counts")
oracle("r08_combine_ngrams", "ngram_counts known", f"""SELECT ngram, {SIZE}, freq FROM (SELECT ngram FROM ngram_counts
    WHERE freq >= {N_DOCS} // 100 UNION SELECT ngram FROM known) LEFT JOIN ngram_counts USING (ngram)""")
oracle("r09_replace_ngrams", "articles texts", """SELECT id, md5(list_reduce(list_prepend(title, p), lambda a, x:
    regexp_replace(a, x, '\\1\\2_\\3', 'g'))) AS title, md5(list_reduce(list_prepend(abstract, p), lambda a, x:
    regexp_replace(a, x, '\\1\\2_\\3', 'g'))) AS abstract FROM articles, patterns""", f"""
    patterns AS (SELECT list('(?i)(^|[^\\p{{L}}\\p{{N}}_])(' || split_part(ngram, ' ', 1) || ')\\s+(' ||
    split_part(ngram, ' ', 2) || ')' ORDER BY freq DESC, ngram) AS p FROM (SELECT ngram, count(*) AS freq
    FROM texts JOIN ({values([(g,) for g in TWO_PARTS], 'ngram')}) ON contains(text, ngram) GROUP BY ngram))""")
oracle("r10_stat_embeddings", "counts", "SELECT embedding, article_id, dim, n FROM counts")
oracle("r11_encode_articles", "gaps", "SELECT * FROM encoded", """src AS (SELECT id,
    replace(title || ' ' || abstract, chr(10), ' ') AS text FROM gaps WHERE title IS NOT NULL AND abstract IS NOT NULL),"""
       + pooled("src"))
oracle("r12_combine_embeddings", "repeated", """SELECT article_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
    round(unnest(embedding), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY version DESC) AS r
    FROM repeated) WHERE r = 1""")

REWRITTEN = ", ".join(f"md5({joined(c, ['der die', 'of the'])}) AS {c}" for c in ("title", "abstract"))
oracle("f01_regex_rewrite", "articles", f"SELECT id, {REWRITTEN} FROM articles")
oracle("f02_variance_test", "flat", "SELECT article_id, list_max(embedding) = list_min(embedding) AS constant FROM flat")
oracle("f03_sql_functions", "scored", "SELECT token, round(ridf, 6) AS ridf, round(idf, 6) AS idf FROM scored")
oracle("f04_batch_inference", "articles", "SELECT * FROM encoded",
       "src AS (SELECT id, replace(title || ' ' || abstract, chr(10), ' ') AS text FROM articles)," + pooled("src"))
NEAR_TERMS = """SELECT article_id, neighbour, CAST(rank AS INTEGER) AS rank, distance FROM (SELECT *, row_number() OVER
    (PARTITION BY article_id ORDER BY distance, neighbour) AS rank FROM (SELECT a.id AS article_id, b.id AS neighbour,
    greatest(round(1 - coalesce({likeness}, 0), 9), 0) AS distance FROM articles a JOIN articles b ON a.id <> b.id
    LEFT JOIN {both} ON x = a.id AND y = b.id)) WHERE rank <= 5"""


def shared_terms(name: str, source: str, pair: str, own: str) -> str:
    """`name`: (x, y, likeness) of all articles with a common term."""
    return f"""{name}_own AS (SELECT id, {own} AS own FROM {source} GROUP BY id),
    {name} AS (SELECT x, y, {pair} AS likeness FROM (SELECT a.id AS x, b.id AS y, count(*) AS k, sum(a.weight * b.weight) AS dot
    FROM {source} a JOIN {source} b ON a.token = b.token AND a.id <> b.id GROUP BY a.id, b.id)
    JOIN {name}_own p ON p.id = x JOIN {name}_own q ON q.id = y)"""


DOT = "dot / nullif(sqrt(p.own) * sqrt(q.own), 0)"
PARTS["tfidf"] = ("SELECT id, token, a.tf * idf AS weight FROM article_stats a JOIN scored USING (token)", "article_stats scored")
oracle("e01_jaccard_neighbours", "articles article_stats", NEAR_TERMS.format(likeness="likeness", both="alike"),
       shared_terms("alike", "(SELECT id, token, 1 AS weight FROM article_stats)", "k / (p.own + q.own - k)", "count(*)"))
oracle("e02_cosine_neighbours", "articles tfidf", NEAR_TERMS.format(likeness="likeness", both="alike"),
       shared_terms("alike", "tfidf", DOT, "sum(weight * weight)"))
oracle("e03_neighbourhood_overlap", "articles tfidf vocab", """SELECT article_id, count(s.neighbour) AS shared
    FROM wide LEFT JOIN narrow s USING (article_id, neighbour) GROUP BY article_id""",
       shared_terms("alike", "tfidf", DOT, "sum(weight * weight)") + """,
    few AS (SELECT * FROM tfidf WHERE token IN (SELECT token FROM vocab WHERE embedding = 'ensemble')),
    """ + shared_terms("alike_few", "few", DOT, "sum(weight * weight)")
       + ", wide AS (" + NEAR_TERMS.format(likeness="likeness", both="alike") + "), narrow AS (" + NEAR_TERMS.format(likeness="likeness", both="alike_few") + ")")
oracle("e04_term_network", "pairs", """SELECT token, count(*) AS degree, round(sum(cor), 6) AS strength FROM (
    SELECT token1 AS token, cor FROM pairs UNION ALL SELECT token2, cor FROM pairs) GROUP BY token""")


def run_all_rows() -> None:
    """Row counts of a run, whose tokens come from texts with the known n-grams collapsed."""
    kept = PARTS["tokens"]
    PARTS["tokens"] = PARTS["joined_tokens"]
    counted = {
        "stats/articles": "article_stats", "stats/tokens": "totals", "stats/co-occurrence": "presence",
        "stats/token-correlations": "correlations", "stats/correlated-token-pairs": "pairs", "ngrams/batches": "ngram_counts",
        "ngrams/counts": "ngram_counts", "embeddings/counts": "counts", "embeddings/batches": "articles", "embeddings/encoded": "articles",
        "clusters/encoded": "articles", "projections/encoded": "(SELECT article_id FROM encoded GROUP BY article_id HAVING max(exact) > min(exact))",
    }
    for kind in KINDS:
        counted |= {f"embeddings/vectors/{kind}": "articles", f"clusters/{kind}": "articles"}
        counted[f"projections/{kind}"] = f"""(SELECT article_id FROM counts WHERE embedding = '{kind}' GROUP BY article_id
            HAVING count(*) < 64 OR max(n) > min(n))"""
    rows = [f"SELECT '{name}' AS name, count(*) AS rows FROM {source}" for name, source in counted.items()]
    rows += ["SELECT 'embeddings/tokens', 64", "SELECT 'neighbours/encoded', count(*) * least(15, count(*) - 1) FROM articles"]
    sent = pooled("src").replace("AS value", "AS value, avg(coalesce(v, 0.0)) AS exact")
    oracle("r16_run_all", "articles article_stats totals presence correlations pairs ngram_counts counts", " UNION ALL ".join(rows),
           "src AS (SELECT id, replace(title || ' ' || abstract, chr(10), ' ') AS text FROM articles)," + sent)
    PARTS["tokens"] = kept


run_all_rows()

# what holds for every clustering and every projection by principal components
oracle("v02_kmeans", "emb", "SELECT article_id, CAST(1 AS BIGINT) AS labels, true AS nearest FROM emb")
oracle("r13_cluster_counts", "articles", "SELECT id AS article_id, CAST(1 AS BIGINT) AS labels, true AS nearest FROM articles")
PROJECTED = "SELECT count(*) AS articles, true AS centred, true AS uncorrelated, true AS in_order, true AS widest FROM "
oracle("v05_project", "flat", PROJECTED + "flat WHERE list_max(embedding) > list_min(embedding)")
oracle("r14_project_counts", "counts", PROJECTED + """(SELECT article_id FROM counts WHERE embedding = 'ensemble' GROUP BY article_id
    HAVING count(*) < 64 OR max(n) > min(n))""")

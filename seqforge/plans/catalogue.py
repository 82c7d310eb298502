"""Every query of the package by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features
from ..functions import sequences as S
from ..models import BASES, EchoModel, KmerModel, SequenceModel, batched, code_points
from ..tokens import KmerTokenModel, MixedModel, TokenModel, Tokens
from ..operators import control, metrics, probes, results, tensors, vectors
from ..sources import tables
from ..sources.shared import written
from . import stand_ins as L
from . import tasks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark, d):
    out = tasks.essentiality(L.labelled(spark, d), k=3, width=1000)
    return out.select("genome", "n_genes", "n_essential", "scored", F.round("auroc", 6).alias("auroc"), F.round("auprc", 6).alias("auprc"))


def _r(*names, to=6):
    return [F.round(n, to).alias(n) for n in names]


def _named(df, **columns):
    return df.select(*[c.alias(n) if isinstance(c, F.Column) else F.col(c).alias(n) for n, c in columns.items()])


class CodeModel(SequenceModel):
    """Logits of a place by the letters' codes, and sequences by their share of G and C, so that SQL can say the same."""

    name, capabilities, n_layers = "code", frozenset({"variant_llr", "embed"}), 1

    def site_logits(self, reference, pos0):
        return [ord(c) / (1.0 + pos0) for c in BASES]

    def share(self, seqs, *sets):
        """sequences x sets: the share of each set's letters."""
        codes, ends = code_points(seqs)
        sizes = np.diff(ends, prepend=0)
        before = [np.concatenate(([0], np.cumsum(np.isin(codes, [ord(c) for c in letters])))) for letters in sets]
        return np.stack([(n[ends] - n[ends - sizes]) / np.maximum(1, sizes) for n in before], axis=1)

    def embed(self, seqs, layers="last"):
        return self.share(seqs, "GC")[:, :, None]


class CountedModel(CodeModel):
    """Both heads of one run: the share of G and C, in layer 0 that of A; a letter's log-probability by its code.
    ``calls`` counts the sequences that it was run on."""

    name, capabilities, n_layers = "counted", frozenset({"embed", "per_token"}), 2

    def __init__(self, calls):
        self.calls = calls

    def embed(self, seqs, layers="last"):
        self.calls.add(len(seqs))
        x = self.share(seqs, "A", "GC")[:, :, None]
        return x if layers == "all" else x[:, 1:]

    def per_token(self, seqs):
        self.calls.add(len(seqs))
        codes, ends = code_points(seqs)
        return np.split(codes / -100.0, ends[:-1])

    def embed_with_logprobs(self, seqs, layers="last", pool="mean"):
        out = self.embed(seqs, layers), self.per_token(seqs)
        self.calls.add(-len(seqs))
        return out


class CodeKmerModel(KmerTokenModel):
    """3-mers at every second letter; logits by the k-mer's number, its token and how many are masked with it."""

    name, k, shift = "code-kmer", 3, 2

    def number(self, kmer):
        found = super().number(kmer)
        return None if found is None or found % 7 == 3 else found

    def set_logits(self, reference, tokens, wanted):
        return [[x / (1.0 + j) + x * x / (10.0 * len(tokens)) for x in row] for j, row in zip(tokens, wanted)]


class WordModel(TokenModel):
    """Tokens of one to three letters between special ones; a token's state is its letters' codes and its width."""

    name, n_layers = "word", 1

    def run_tokens(self, seqs, layers):
        codes, ends = code_points(seqs)
        out, begin, outer = [], 0, [float(sum(map(ord, p))) for p in ("<s>", "</s>")]
        for end in ends.tolist():
            own, begin = codes[begin:end], end
            j = np.arange(len(own) // 6 * 3 + 3)
            start = 6 * (j // 3) + np.array([0, 1, 3])[j % 3]
            start = start[start < len(own)]
            n = len(start)
            special, spans, states = np.ones(n + 2, bool), np.zeros((n + 2, 2), np.int64), np.full((n + 2, 1, 2), 100.0)
            special[1:-1], states[[0, -1], 0, 0] = False, outer
            if n:
                spans[1:-1, 0], spans[1:-1, 1] = start, np.append(start[1:], len(own))
                states[1:-1, 0, 0], states[1:-1, 0, 1] = np.add.reduceat(own, start, dtype=np.int64), spans[1:-1, 1] - start
            out.append(Tokens(states, special, spans))
        return out


class HalvingModel(MixedModel):
    """Three layers of 1, 2 and 8 letters a place: the places' letters' codes, padding as 0."""

    name, n_layers, multiple = "halving", 3, 16

    def run_padded(self, seqs, padded):
        codes, ends = code_points(seqs)
        x, sizes = np.zeros((len(seqs), padded)), np.diff(ends, prepend=0)
        x[np.arange(padded) < sizes[:, None]] = codes  # row by row
        return [x.reshape(len(seqs), -1, f).sum(axis=2, keepdims=True) for f in (1, 2, 8)]


class ScoreModel(EchoModel):
    """The echo model without log-odds of sites."""

    name, capabilities = "echo-score", frozenset({"score"})


def _result(spark, record, keys):
    """metric, value of the one task of a record; its error raises."""
    task = record["tasks"][0]
    if task["status"] != "ok":
        raise ValueError(task["metadata"])
    return spark.createDataFrame([(k, float(task["metrics"][k])) for k in keys if k in task["metrics"]], "metric string, value double").withColumn("value", F.round("value", 7))


# -- sources --------------------------------------------------------------------------------------
@query(f"""WITH {L.LABELLED}, g AS (SELECT CASE WHEN doc_id % 97 = 0 THEN '' ELSE genome END AS genome_name, CASE WHEN doc_id % 193 = 0 THEN 'other' ELSE genus END AS genus,
  CASE WHEN doc_id % 61 = 0 THEN 'x' ELSE CAST(essential AS VARCHAR) END AS essential, CASE WHEN doc_id % 89 = 0 THEN '' ELSE seq END AS sequence FROM seqs),
p AS (SELECT 'empty genome' AS problem, count(*) FILTER (genome_name = '') AS n FROM g UNION ALL SELECT 'label not 0 or 1', count(*) FILTER (essential NOT IN ('0', '1')) FROM g
  UNION ALL SELECT 'empty sequence', count(*) FILTER (sequence = '') FROM g
  UNION ALL SELECT 'genus differs within a genome', count(*) FROM (SELECT genome_name FROM g GROUP BY 1 HAVING count(DISTINCT genus) > 1)
  UNION ALL SELECT 'no rows', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM g) SELECT problem, CAST(n AS BIGINT) AS n FROM p WHERE n > 0""")
def scan_contract_violations(spark, d):
    s, i = L.labelled(spark, d), F.col("doc_id")
    rows = _named(s, genome_name=F.when(i % 97 == 0, "").otherwise(F.col("genome")), genus=F.when(i % 193 == 0, "other").otherwise(F.col("genus")), essential=F.when(i % 61 == 0, "x").otherwise(F.col("essential").cast("string")), sequence=F.when(i % 89 == 0, "").otherwise(F.col("seq")))
    return tables.gene_violations(rows)


@query(f"""WITH {L.VARIANTS} SELECT dms_id, count(*) AS n, round(sum(dms_score), 2) AS total FROM variants
  WHERE trim(mutant) <> '' AND lower(trim(mutant)) <> 'nan' AND l_orderkey % 11 <> 0 GROUP BY dms_id""")
def wildtype_drop(spark, d):
    v = L.variants(spark, d).withColumn("dms_score", F.when(F.col("l_orderkey") % 11 == 0, "bad").otherwise(F.col("dms_score").cast("string")))
    return tables.drop_wild_types(v).groupBy("dms_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dms_score"), 2).alias("total"))


@query(f"""WITH {L.LABELLED} SELECT split, count(DISTINCT genome) AS n_genomes, count(*) AS n_genes, CAST(sum(essential) AS BIGINT) AS n_essential, CAST(sum(length(seq)) AS BIGINT) AS total_nt,
  CAST(min(length(seq)) AS INTEGER) AS min_nt, CAST(max(length(seq)) AS INTEGER) AS max_nt, round(avg(length(seq)), 6) AS avg_nt, string_agg(DISTINCT genus, ',' ORDER BY genus) AS genera FROM seqs GROUP BY split""")
def split_stats(spark, d):
    return tables.split_stats(L.labelled(spark, d).withColumnsRenamed({"genome": "genome_name", "seq": "sequence"})).withColumn("avg_nt", F.round("avg_nt", 6))


@query(f"""WITH {L.LABELLED} SELECT split, count(DISTINCT genome) AS genomes, count(*) AS genes, CAST(sum(essential) AS BIGINT) AS essential, round(100.0 * sum(essential) / count(*), 4) AS percent FROM seqs GROUP BY split""")
def manifest_summary(spark, d):
    return tables.manifest_summary(L.labelled(spark, d), "genome").withColumn("percent", F.round("percent", 4))


@query(f"""WITH {L.SEQS}, f AS (SELECT genome, min(doc_id) AS first FROM seqs GROUP BY 1 ORDER BY 2, 1 LIMIT 7) SELECT doc_id, genome FROM seqs WHERE genome IN (SELECT genome FROM f)""")
def first_n_groups(spark, d):
    return tables.first_groups(L.seqs(spark, d), "genome", "doc_id", 7).select("doc_id", "genome")


@query(f"""WITH {L.SEQS}, f AS (SELECT genome, min(doc_id) AS first FROM seqs GROUP BY 1 ORDER BY 2, 1 LIMIT 7) SELECT round(count(*) / CAST(count(*) FILTER (genome IN (SELECT genome FROM f)) AS DOUBLE), 6) AS ratio FROM seqs""")
def extrapolation_ratio(spark, d):
    s = L.seqs(spark, d)
    return tables.extrapolation_ratio(s, tables.first_groups(s, "genome", "doc_id", 7)).select(F.round("ratio", 6).alias("ratio"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_rows(spark, d):
    return tables.sequence_digests(L.table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT doc_id, 'c' || k AS contig, k AS start, k + 9 AS "end", CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST((doc_id + k) % 2 AS INTEGER) AS essential
  FROM (SELECT doc_id, unnest(range(1, 1 + CAST(doc_id % 4 AS BIGINT))) AS k FROM documents)""")
def flatten_genomes(spark, d):
    k = F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int"))
    k = F.when(F.col("doc_id") % 4 > 0, k).otherwise(F.array().cast("array<int>"))
    one = lambda f: F.transform(k, lambda x: F.array(f(x)))
    nested = L.table(spark, d, "documents").select(F.col("doc_id").alias("genome_name"), F.lit("g").alias("genus"), F.transform(k, lambda x: F.concat(F.lit("c"), x.cast("string"))).alias("dna_sequence"), one(lambda x: x.cast("long")).alias("start"), one(lambda x: (x + 9).cast("long")).alias("end"), one(lambda x: F.when(x % 2 == 0, "+").otherwise("-")).alias("strand"), one(lambda x: ((F.col("doc_id") + x) % 2).cast("int")).alias("essential"))
    return tables.flatten_genomes(nested).select(F.col("genome_name").alias("doc_id"), F.col("dna").alias("contig"), "start", "end", "strand", "essential")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2'")
def assay_selection(spark, d):
    return tables.select_assays(L.table(spark, d, "part"), p_type="ECONOMY", p_brand="Brand#2").select("p_partkey", "p_name")


@query(f"WITH {L.VARIANTS} SELECT dms_id, count(*) AS n_rows, CAST(max(length(sequence)) AS INTEGER) AS cds_len FROM variants GROUP BY dms_id")
def source_stats(spark, d):
    return tables.source_stats(L.variants(spark, d))


# -- sequences ------------------------------------------------------------------------------------
@query(f"WITH {L.SEQS} SELECT doc_id, CAST(length(seq) AS INTEGER) AS n, sha256(seq) AS seq_sha256 FROM seqs")
def normalize(spark, d):
    return L.seqs(spark, d).select("doc_id", F.length("seq").alias("n"), F.sha2("seq", 256).alias("seq_sha256"))


_GENE = """g AS (SELECT doc_id, seq, CAST(doc_id % 40 + 1 AS INTEGER) AS s, CAST(doc_id % 40 + 50 AS INTEGER) AS e, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS strand FROM seqs),
  h AS (SELECT doc_id, seq, greatest(1, s - CASE WHEN strand IS NULL OR strand > 0 THEN 32 ELSE 0 END) AS a, least(length(seq), e + CASE WHEN strand IS NULL OR strand <= 0 THEN 32 ELSE 0 END) AS b FROM g)"""


@query(f"WITH {L.SEQS}, {_GENE} SELECT doc_id, substr(seq, a, greatest(0, b - a + 1)) AS gene FROM h")
def gene_extract(spark, d):
    i = F.col("doc_id")
    strand = F.when(i % 3 == 0, 1).when(i % 3 == 1, -1)
    return L.seqs(spark, d).select("doc_id", S.gene_extract(F.col("seq"), (i % 40 + 1).cast("int"), (i % 40 + 50).cast("int"), strand, 32).alias("gene"))


_MUTS = r"""m AS (SELECT l_orderkey, variant_idx, dms_id, sequence, mutant, list_filter(list_transform(string_split_regex(mutant, '[,:]'), lambda x: trim(x)), lambda x: x <> '') AS tk FROM variants),
  ok AS (SELECT *, len(tk) > 0 AND len(list_filter(tk, lambda x: NOT regexp_matches(x, '^[ACGTUacgtu][1-9][0-9]*[ACGTUacgtu]$'))) = 0 AS good FROM m),
  sites AS (SELECT l_orderkey, variant_idx, dms_id, sequence, i, CAST(substr(t, 2, length(t) - 2) AS INTEGER) - 1 AS pos0, translate(upper(substr(t, 1, 1)), 'U', 'T') AS wt, translate(upper(substr(t, length(t), 1)), 'U', 'T') AS mut
    FROM (SELECT l_orderkey, variant_idx, dms_id, sequence, unnest(range(len(tk))) AS i, unnest(tk) AS t FROM ok WHERE good))"""


@query(f"WITH {L.VARIANTS}, {_MUTS} SELECT l_orderkey, variant_idx, CAST(i AS INTEGER) AS i, pos0, wt, mut FROM sites")
def parse_mutant(spark, d):
    p = L.variants(spark, d).where(S.scoreable(F.col("mutant"))).select("l_orderkey", "variant_idx", F.posexplode(S.parse_mutant(F.col("mutant"))).alias("i", "m"))
    return p.select("l_orderkey", "variant_idx", "i", "m.pos0", "m.wt", "m.mut")


@query(f"""WITH {L.VARIANTS}, {_MUTS} SELECT dms_id, count(DISTINCT (l_orderkey, variant_idx, sequence, good)) AS n_distinct, count(*) FILTER (good) AS n_scoreable, count(*) FILTER (NOT good) AS n_unscoreable FROM ok GROUP BY dms_id""")
def scoreable_variants(spark, d):
    v = L.variants(spark, d).withColumn("good", S.scoreable(F.col("mutant")))
    return v.groupBy("dms_id").agg(F.countDistinct("l_orderkey", "variant_idx", "sequence", "good").alias("n_distinct"), F.count_if("good").alias("n_scoreable"), F.count_if(~F.col("good")).alias("n_unscoreable"))


@query("""SELECT concat(l_returnflag, l_linestatus) AS dms_id, CAST(0 AS BIGINT) AS n_bad, CAST(1 AS BIGINT) AS n_references, repeat(substr('ACGTTGCA', CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, 5), 3) AS reference, count(*) AS n_scoreable FROM lineitem WHERE l_linenumber >= 3 GROUP BY l_returnflag, l_linestatus""")
def wt_reconstruct(spark, d):
    ref = F.repeat(F.substring(F.lit("ACGTTGCA"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3), F.lit(5)), 3)
    li = L.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("dms_id"), F.col("l_linenumber").alias("p"), ref.alias("ref"))
    wt = F.substring("ref", F.col("p"), F.lit(1))
    mut = F.translate(wt, "ACGT", "CGTA")
    made = li.select("dms_id", F.when(F.col("p") >= 3, F.concat(wt, F.col("p").cast("string"), mut)).otherwise("").alias("mutant"), F.when(F.col("p") >= 3, F.overlay("ref", mut, F.col("p"), F.lit(1))).otherwise(F.col("ref")).alias("sequence"))
    return S.assay_check(made.where(S.scoreable(F.col("mutant"))).withColumn("mutations", S.parse_mutant(F.col("mutant"))))


def _windows_sql(width, step, least=0):
    return f"""w AS (SELECT doc_id, seq, i, substr(seq, CAST(i * {step} + 1 AS BIGINT), {width}) AS win FROM (SELECT doc_id, seq, unnest(range(CASE WHEN length(seq) = 0 THEN 0 WHEN length(seq) <= {width} THEN 1 ELSE CAST(ceil((length(seq) - {width}) / {float(step)}) AS BIGINT) + 1 END)) AS i FROM seqs))"""


@query(f"WITH {L.SEQS}, {_windows_sql(100, 68)} SELECT doc_id, CAST(i AS INTEGER) AS i, win FROM w")
def windows(spark, d):
    return L.seqs(spark, d).select("doc_id", F.posexplode(S.windows(F.col("seq"), 100)).alias("i", "win"))


@query(f"WITH {L.SEQS}, {_windows_sql(100, 68)}, k AS (SELECT doc_id, win FROM w WHERE length(win) >= 32) SELECT doc_id, win FROM k UNION ALL SELECT doc_id, seq FROM seqs WHERE doc_id NOT IN (SELECT doc_id FROM k)")
def window_policy_gene(spark, d):
    return L.seqs(spark, d).select("doc_id", F.explode(S.gene_windows(F.col("seq"), 100)).alias("win"))


@query(f"""WITH {L.SEQS}, {_windows_sql(60, 28)}, k AS (SELECT doc_id, win FROM w WHERE length(win) >= 32 AND length(seq) > 60) SELECT doc_id, win FROM k
  UNION ALL SELECT doc_id, CASE WHEN length(seq) <= 60 THEN seq ELSE substr(seq, (length(seq) - 60) // 2 + 1, 60) END FROM seqs WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def window_policy_ec(spark, d):
    return L.seqs(spark, d).select("doc_id", F.explode(S.enzyme_windows(F.col("seq"), 60)).alias("win"))


@query(f"WITH {L.SEQS} SELECT doc_id, CASE WHEN length(seq) > 50 THEN substr(seq, (length(seq) - 50) // 2 + 1, 50) ELSE seq END AS win FROM seqs")
def central_window(spark, d):
    return L.seqs(spark, d).select("doc_id", S.central_window(F.col("seq"), 50).alias("win"))


@query(f"""WITH {L.VARIANTS}, {_MUTS} SELECT dms_id, count(*) FILTER (NOT good) AS n_unscoreable, count(*) FILTER (good AND length(sequence) > 20) AS n_over_context, count(*) FILTER (good AND length(sequence) <= 20) AS n_kept FROM ok GROUP BY dms_id""")
def context_skip(spark, d):
    return S.context_report(L.variants(spark, d), 20)


@query("""SELECT p_partkey, CAST(unnest(list_concat([p_size % 5], range(CAST(p_size % 7 AS BIGINT), CAST(p_size % 7 + 3 AS BIGINT)))) AS INTEGER) AS layer FROM part""")
def layer_parse(spark, d):
    n = F.col("p_size")
    spec = F.concat((n % 5).cast("string"), F.lit(", "), (n % 7).cast("string"), F.lit("-"), (n % 7 + 2).cast("string"))
    return L.table(spark, d, "part").select("p_partkey", F.explode(S.layer_list(spec)).alias("layer"))


@query("""SELECT l_orderkey, l_linenumber, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS token FROM (SELECT l_orderkey, l_linenumber, greatest(0, CAST(floor((l_suppkey % 60 - 6) / 2.0) AS BIGINT) + 1) AS lo, least(CAST(floor((CAST(l_quantity AS BIGINT) + 10 - 6) / 2.0) AS BIGINT), CAST(floor(l_suppkey % 60 / 2.0) AS BIGINT)) AS hi FROM lineitem) WHERE lo <= hi""")
def affected_tokens(spark, d):
    t = S.affected_tokens((F.col("l_suppkey") % 60).cast("int"), F.col("l_quantity").cast("int") + 10, 6, 2)
    return L.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(t).alias("token"))


@query("SELECT p_partkey, CAST(j * 2 AS INTEGER) AS start, CAST(j * 2 + 6 AS INTEGER) AS \"end\" FROM (SELECT p_partkey, unnest(range(CASE WHEN p_size >= 6 THEN (p_size - 6) // 2 + 1 ELSE 0 END)) AS j FROM part)")
def token_spans(spark, d):
    return L.table(spark, d, "part").select("p_partkey", F.explode(S.token_spans(F.col("p_size"), 6, 2)).alias("s")).select("p_partkey", "s.start", "s.end")


# -- features -------------------------------------------------------------------------------------
def _kmers(k):
    sql = f"""WITH {L.SEQS}, w AS (SELECT doc_id, substr(seq, CAST(i AS BIGINT), {k}) AS kmer FROM (SELECT doc_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs)),
      c AS (SELECT doc_id, kmer, count(*) AS n FROM w WHERE kmer NOT LIKE '%N%' GROUP BY ALL) SELECT doc_id, kmer, n, round(n / CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE), 9) AS freq FROM c"""

    @query(sql, f"kmer_k{k}")
    def run(spark, d):
        c = features.kmer_counts(L.seqs(spark, d), "doc_id", "seq", k)
        total = c.groupBy("doc_id").agg(F.sum("n").alias("total"))
        return c.join(total, "doc_id").select("doc_id", features.kmer_name(F.col("kmer"), k).alias("kmer"), "n", F.round(F.col("n") / F.col("total").cast("double"), 9).alias("freq"))


for _k in (1, 2, 3, 4):
    _kmers(_k)

_ECHO = "e AS (SELECT doc_id, CAST(sum(-((ascii(c) * 2654435761) & 65535) / 65535.0) AS DOUBLE) AS s, count(*) AS n FROM (SELECT doc_id, unnest(string_split(seq, '')) AS c FROM seqs) WHERE c <> '' GROUP BY doc_id)"


@query(f"WITH {L.SEQS}, {_ECHO} SELECT doc_id, round(coalesce(s, 0.0), 7) AS score_sum, round(coalesce(s / n, 0.0), 9) AS score_mean FROM seqs LEFT JOIN e USING (doc_id)")
def echo_score(spark, d):
    return L.seqs(spark, d).select("doc_id", F.round(features.echo_sum(F.col("seq")), 7).alias("score_sum"), F.round(features.echo_mean(F.col("seq")), 9).alias("score_mean"))


@query(f"WITH {L.SEQS}, {_ECHO}, m AS (SELECT coalesce(s / n, 0.0) AS x FROM seqs LEFT JOIN e USING (doc_id)) SELECT round(avg(x), 8) AS mean, round(min(x), 9) AS least, round(max(x), 9) AS most FROM m")
def score_summary(spark, d):
    x = metrics.score_summary(L.seqs(spark, d).select(features.echo_mean(F.col("seq")).alias("x")), "x")
    return x.select(F.round("mean", 8).alias("mean"), F.round("least", 9).alias("least"), F.round("most", 9).alias("most"))


@query()
def echo_embed(spark, d):
    return EchoModel().embeddings(L.seqs(spark, d), "doc_id", "seq", "all").select("doc_id", "layer_id", F.posexplode("vec").alias("dim", "x"))


@query()
def echo_llr(spark, d):
    v = L.variants(spark, d).withColumn("key", F.struct("l_orderkey", "variant_idx", "sequence").cast("string")).withColumn("reference", F.col("sequence")).where(S.scoreable(F.col("mutant"))).withColumn("mutations", S.parse_mutant(F.col("mutant")))
    return EchoModel().variant_llrs(v.dropDuplicates(["key"]), "key")


@query(f"""WITH {L.VARIANTS}, {_MUTS}, distinct_sites AS (SELECT DISTINCT sequence, pos0 FROM sites) SELECT dms_id, (SELECT count(*) FROM distinct_sites) AS n_scored, count(*) AS n_sites, round(sum((ascii(mut) - ascii(wt)) / (1.0 + pos0)), 6) AS llr FROM sites GROUP BY dms_id""")
def llr_dedup_join(spark, d):
    v = L.variants(spark, d).where(S.scoreable(F.col("mutant"))).withColumn("mutations", S.parse_mutant(F.col("mutant"))).withColumn("reference", F.col("sequence")).withColumn("_id", F.struct("dms_id", "variant_idx"))
    llr = CodeModel().variant_llrs(v, "_id").groupBy("_id.dms_id").agg(F.round(F.sum("llr"), 6).alias("llr"))
    # counted once for both numbers: a row an assay, reference and place
    sites = written(v.select("dms_id", "reference", F.explode_outer("mutations.pos0").alias("pos0")).where("pos0 IS NOT NULL").groupBy("dms_id", "reference", "pos0").count(), "site-counts")
    n = sites.select("reference", "pos0").distinct().agg(F.count(F.lit(1)).alias("n_scored"))
    return llr.join(sites.groupBy("dms_id").agg(F.sum("count").alias("n_sites")), "dms_id").crossJoin(n)


def _pool(how, sql):
    @query(f"WITH {L.EMB} SELECT item // 5 AS item, CAST(layer_id AS INTEGER) AS layer_id, CAST(dim AS INTEGER) AS dim, round({sql}, 9) AS x FROM emb GROUP BY ALL", f"token_pool_{how}")
    def run(spark, d):
        e = L.emb(spark, d).withColumn("token", F.col("item") % 5).withColumn("item", F.expr("item div 5"))
        return vectors.pool(e, ["item", "layer_id"], "token", how).select("item", "layer_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 9))


for _h, _q in (("mean", "avg(x)"), ("max", "max(x)"), ("last", "arg_max(x, item)"), ("bos", "arg_min(x, item)")):
    _pool(_h, _q)


@query(f"WITH {L.SEQS}, b AS (SELECT doc_id // 32 AS batch, sum(length(seq)) AS t, max(length(seq)) * count(*) AS slots FROM seqs GROUP BY 1) SELECT round(CAST(sum(t) AS DOUBLE) / sum(slots), 9) AS efficiency FROM b")
def padding_efficiency(spark, d):
    b = L.seqs(spark, d).select(F.expr("doc_id div 32").alias("batch"), F.length("seq").alias("length"))
    return vectors.padding_efficiency(b).select(F.round("efficiency", 9).alias("efficiency"))


@query()
def length_bucketing(spark, d):
    return batched(L.seqs(spark, d), "doc_id", "seq", 65536)


@query(f"""WITH {L.SEQS}, x AS (SELECT doc_id, CAST(ceil(greatest(1, length(seq)) / 128.0) AS BIGINT) * 128 AS padded FROM seqs), c AS (SELECT padded, count(*) AS n FROM x GROUP BY 1)
  SELECT padded, n AS n_rows, true AS alike, true AS within FROM c""")
def equal_length_batches(spark, d):
    b = batched(L.seqs(spark, d), "doc_id", "seq", None, batch_size=8, multiple=128).withColumn("padded", F.greatest(tensors.padded_length(F.col("length")), F.lit(128)))
    each = b.groupBy("batch").agg(F.min("padded").cast("long").alias("padded"), F.count(F.lit(1)).alias("n"), (F.min("padded") == F.max("padded")).alias("alike"))
    return each.groupBy("padded").agg(F.sum("n").alias("n_rows"), F.min("alike").alias("alike"), (F.max("n") <= 8).alias("within"))


_KMER = "(4 * (4 * (instr('ACGT', substr(w, 1, 1)) - 1) + instr('ACGT', substr(w, 2, 1)) - 1) + instr('ACGT', substr(w, 3, 1)) - 1)"


@query(f"""WITH {L.VARIANTS}, {_MUTS},
  t AS (SELECT l_orderkey, variant_idx, dms_id, sequence, pos0, mut, lo, hi, unnest(range(lo, hi + 1)) AS j FROM (SELECT *, greatest(0, CAST(floor((pos0 - 3) / 2.0) AS BIGINT) + 1) AS lo, least((length(sequence) - 3) // 2, pos0 // 2) AS hi FROM sites)),
  w AS (SELECT *, substr(sequence, CAST(2 * j + 1 AS BIGINT), 3) AS wt_w, concat(substr(sequence, CAST(2 * j + 1 AS BIGINT), CAST(pos0 - 2 * j AS BIGINT)), mut, substr(sequence, pos0 + 2, CAST(2 * j + 2 - pos0 AS BIGINT))) AS mut_w FROM t),
  v AS (SELECT *, {_KMER.replace("(w,", "(wt_w,")} AS a, {_KMER.replace("(w,", "(mut_w,")} AS b, hi - lo + 1 AS m FROM w),
  u AS (SELECT *, a % 7 = 3 OR b % 7 = 3 AS unknown, (b - a) / (1.0 + j) + (b * b - a * a) / (10.0 * m) AS gain FROM v)
  SELECT dms_id, round(sum(CASE WHEN unknown THEN 0 ELSE gain END), 5) AS llr, CAST(count(*) FILTER (unknown) AS BIGINT) AS n_unknown FROM u GROUP BY dms_id""")
def token_set_llr(spark, d):
    v = L.variants(spark, d).where(S.scoreable(F.col("mutant"))).withColumn("reference", F.col("sequence")).withColumn("_id", F.struct("dms_id", "variant_idx", "l_orderkey"))
    llr = CodeKmerModel().token_set_llrs(v.withColumn("mutations", S.parse_mutant(F.col("mutant"))), "_id")
    return llr.groupBy("_id.dms_id").agg(F.round(F.sum("llr"), 5).alias("llr"), F.sum("n_unknown").alias("n_unknown"))


@query("""WITH t AS (SELECT p_partkey, i, s, i % 3 = 1 AS special FROM (SELECT p_partkey, unnest(range(1, 1 + len(string_split(p_name, ' ')))) AS i, unnest(string_split(p_name, ' ')) AS s FROM part)),
  e AS (SELECT *, CAST(sum(CASE WHEN special THEN 0 ELSE length(s) END) OVER (PARTITION BY p_partkey ORDER BY i) AS INTEGER) AS e FROM t)
  SELECT p_partkey, CAST(i - 1 AS INTEGER) AS token, CASE WHEN special THEN 0 ELSE e - CAST(length(s) AS INTEGER) END AS start, CASE WHEN special THEN 0 ELSE e END AS "end" FROM e""")
def piece_spans(spark, d):
    p = L.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("pieces"))
    p = p.withColumn("special", F.transform("pieces", lambda _, i: i % 3 == 0))
    return tensors.piece_spans(p, "p_partkey", "pieces", "special").select("p_partkey", F.posexplode("spans").alias("token", "s")).select("p_partkey", "token", "s.start", "s.end")


@query("""WITH t AS (SELECT p_partkey, unnest(range(1, 1 + len(string_split(p_name, ' ')))) AS i, unnest(string_split(p_name, ' ')) AS s FROM part),
  e AS (SELECT *, sum(length(s)) OVER (PARTITION BY p_partkey ORDER BY i) AS e FROM t) SELECT p_partkey, CAST(unnest(range(CAST(e - length(s) AS BIGINT), CAST(e AS BIGINT))) AS INTEGER) AS pos, CAST(i - 1 AS DOUBLE) / 2 AS value FROM e""")
def token_letters(spark, d):
    p = L.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("pieces"))
    t = tensors.piece_spans(p, "p_partkey", "pieces").withColumn("values", F.transform("spans", lambda _, i: i / F.lit(2.0)))
    return tensors.spread(t, ["p_partkey"], "spans", "values")


def _special_pool(how, sql):
    @query(f"WITH {L.EMB}, t AS (SELECT *, item // 5 AS own, item % 3 = 0 OR item // 5 % 11 = 0 AS special FROM emb), r AS (SELECT * FROM t WHERE NOT special OR own % 11 = 0) SELECT own AS item, CAST(layer_id AS INTEGER) AS layer_id, CAST(dim AS INTEGER) AS dim, round({sql}, 9) AS x FROM r GROUP BY ALL", f"special_pool_{how}")
    def run(spark, d):
        e = L.emb(spark, d).withColumn("token", F.col("item")).withColumn("own", F.expr("item div 5")).withColumn("special", (F.col("item") % 3 == 0) | (F.expr("item div 5") % 11 == 0))
        return vectors.pool(e, ["own", "layer_id"], "token", how, special="special").select(F.col("own").alias("item"), "layer_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 9))


for _h, _q in (("mean", "avg(x)"), ("max", "max(x)"), ("last", "arg_max(x, item)")):
    _special_pool(_h, _q)


@query(f"""WITH {L.SEQS}, s AS (SELECT doc_id, seq, length(seq) AS n FROM seqs WHERE length(seq) > 0), c AS (SELECT doc_id, n, i, ascii(substr(seq, CAST(i + 1 AS BIGINT), 1)) AS x FROM (SELECT doc_id, seq, n, unnest(range(n)) AS i FROM s)),
  f AS (SELECT unnest([1, 2, 8]) AS f), p AS (SELECT doc_id, f, n, i // f AS j, sum(x) AS x FROM c, f GROUP BY ALL)
  SELECT doc_id, CAST(CASE f WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INTEGER) AS layer_id, round(avg(x), 6) AS mean, CAST(max(x) AS DOUBLE) AS most, CAST(arg_max(x, j) AS DOUBLE) AS last FROM p GROUP BY doc_id, f""")
def mixed_resolution_pool(spark, d):
    """The network's layers of 1, 2 and 8 letters a place, pooled each over its own real places."""
    s = L.seqs(spark, d).where("seq <> ''")
    p = HalvingModel().pooled(s, "doc_id", "seq", "all")
    return p.select("doc_id", "layer_id", F.round(F.col("mean")[0], 6).alias("mean"), F.col("max")[0].alias("most"), F.col("last")[0].alias("last"))


@query(f"""WITH e AS (SELECT vec_id, vec_id % 64 + 1 AS n, f, embedding FROM embeddings, (SELECT unnest([1, 2, 8]) AS f)),
  x AS (SELECT vec_id, n, f, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM e), k AS (SELECT vec_id, f, i % f AS dim, i // f AS j, x FROM x WHERE i // f < greatest(1, CAST(ceil(n / CAST(f AS DOUBLE)) AS BIGINT)))
  SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(dim AS INTEGER) AS dim, round(avg(x), 9) AS x FROM k GROUP BY ALL""")
def mixed_places(spark, d):
    """States of 64, 32 and 8 places that stand for 64 letters, of which the first n are real."""
    e = L.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 64 + 1).cast("int").alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    states = lambda f: F.transform(F.sequence(F.lit(0), F.lit(64 // f - 1)), lambda j: F.slice("v", j * f + 1, F.lit(f)))
    each = [F.struct(F.lit(f).alias("f"), tensors.pool_places(states(f), F.col("n"), F.lit(64)).alias("vec")) for f in (1, 2, 8)]
    return e.select("vec_id", F.explode(F.array(*each)).alias("p")).select("vec_id", "p.f", F.posexplode("p.vec").alias("dim", "x")).withColumn("x", F.round("x", 9))


@query(f"""WITH {L.SEQS}, s AS (SELECT doc_id, seq, length(seq) AS n FROM seqs), t AS (SELECT doc_id, seq, n, unnest(range(CAST(n AS BIGINT))) AS j FROM s),
  w AS (SELECT doc_id, seq, n, j, 6 * (j // 3) + CASE j % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS a, j % 3 + 1 AS width FROM t)
  SELECT doc_id, CAST(j AS INTEGER) AS token, CAST(a AS INTEGER) AS start, CAST(least(a + width, n) AS INTEGER) AS "end", CAST(list_sum(list_transform(string_split(substr(seq, CAST(a + 1 AS BIGINT), CAST(width AS BIGINT)), ''), lambda c: ascii(c))) AS DOUBLE) AS x FROM w WHERE a < n""")
def variable_tokens(spark, d):
    """Real tokens of a model with tokens of one to three letters, with the letters that they cover."""
    return WordModel().token_vectors(L.seqs(spark, d), "doc_id", "seq").select("doc_id", "token", "start", "end", F.col("vec")[0].alias("x"))


# -- vectors --------------------------------------------------------------------------------------
@query(f"WITH {L.EMB} SELECT item // 5 AS item, CAST(layer_id AS INTEGER) AS layer_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 9) AS x FROM emb GROUP BY ALL")
def window_mean(spark, d):
    e = L.emb(spark, d).withColumn("item", F.expr("item div 5"))
    return vectors.window_mean(e, ["item", "layer_id"]).select("item", "layer_id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 9))


@query(f"WITH {L.SEQS}, {_windows_sql(100, 68)} SELECT split, count(*) AS n_windows, count(DISTINCT doc_id) AS n_items, count(DISTINCT doc_id) FILTER (length(seq) > 100) AS n_overflow FROM w JOIN (SELECT doc_id, split FROM seqs) USING (doc_id) GROUP BY split")
def overflow_counts(spark, d):
    w = L.seqs(spark, d).select("split", "doc_id", F.length("seq").alias("n"), F.explode(S.windows(F.col("seq"), 100)).alias("w"))
    return vectors.overflow_counts(w, "split", "doc_id", F.col("n") > 100)


@query(f"WITH {L.EMB}, n AS (SELECT item, layer_id, sqrt(sum(x * x)) AS v FROM emb GROUP BY ALL) SELECT CAST(layer_id AS INTEGER) AS layer_id, round(avg(v), 9) AS norm FROM n GROUP BY layer_id")
def embed_norm(spark, d):
    return L.emb(spark, d).groupBy("layer_id").agg(F.round(F.avg(vectors.norm(F.col("vec"))), 9).alias("norm"))


@query(f"WITH {L.EMB}, f AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM emb WHERE layer_id = 0 AND item % 5 <> 0 GROUP BY dim) SELECT item, CAST(dim AS INTEGER) AS dim, round((x - m) / s, 6) AS z FROM emb JOIN f USING (dim) WHERE layer_id = 0")
def standardize(spark, d):
    e = L.emb(spark, d).where("layer_id = 0")
    return vectors.standardise(e, ["item"], F.col("item") % 5 != 0).withColumn("z", F.round("z", 6))


@query("WITH n AS (SELECT count(*) AS n FROM events), w AS (SELECT DISTINCT (i * (n - 1)) // 511 AS row FROM (SELECT unnest(range(512)) AS i), n), r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row FROM events) SELECT event_id FROM r WHERE row IN (SELECT row FROM w)")
def sample_rows(spark, d):
    return vectors.sample_rows(L.table(spark, d, "events").select("event_id"), "event_id", 512)


# -- probes ---------------------------------------------------------------------------------------
def _fit(spark, d, **more):
    return probes.probe(L.emb(spark, d).where("layer_id = 0").withColumn("y", (F.col("label") < 3).cast("int")), train=F.col("item") % 5 != 0, tol=1e-8, **more)


@query()
def probe_binary(spark, d):
    return _fit(spark, d, label="y").select("item", "y", F.round("prob", 4).alias("prob"))


@query()
def probe_multiclass(spark, d):
    return _fit(spark, d, label="label", multiclass=True, scale=False).select("item", "label", "predicted")


@query()
def probe_per_layer(spark, d):
    e = L.emb(spark, d).withColumn("y", (F.col("label") < 3).cast("int"))
    score = lambda rows: metrics.auroc(probes.probe(rows.withColumn("all", F.lit(1)), "y", F.col("item") % 5 != 0, tol=1e-6), ["all"], "y", "prob").first().auroc
    found = probes.probe_layers(e, [0, 1, 2, 3], score)
    return spark.createDataFrame([(k, float(v)) for k, v in found], "layer_id int, auroc double")


@query()
def essentiality_kmer(spark, d):
    return flagship(spark, d)


# -- metrics --------------------------------------------------------------------------------------
_RANK = "r AS (SELECT genome, y, rank() OVER (PARTITION BY genome ORDER BY score) + (count(*) OVER (PARTITION BY genome, score) - 1) / 2.0 AS rk FROM preds), a AS (SELECT genome, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auroc FROM r GROUP BY genome)"
_AP = "s AS (SELECT genome, score, sum(y) AS pos, count(*) AS n FROM preds GROUP BY ALL), t AS (SELECT genome, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY genome) AS p FROM s WINDOW w AS (PARTITION BY genome ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), b AS (SELECT genome, sum(pos / CAST(p AS DOUBLE) * tp / CAST(seen AS DOUBLE)) AS auprc FROM t GROUP BY genome)"


@query(f"WITH {L.PREDS}, {_RANK} SELECT genome, round(auroc, 9) AS auroc FROM a")
def auroc(spark, d):
    return metrics.auroc(L.preds(spark, d), ["genome"], "y", "score").select("genome", *_r("auroc", to=9))


@query(f"WITH {L.PREDS}, {_AP} SELECT genome, round(auprc, 9) AS auprc FROM b")
def auprc(spark, d):
    return metrics.average_precision(L.preds(spark, d), ["genome"], "y", "score").select("genome", *_r("auprc", to=9))


@query(f"WITH {L.PREDS}, {_RANK}, {_AP} SELECT genome, count(*) AS n_genes, CAST(sum(y) AS BIGINT) AS n_essential, true AS scored, round(any_value(auroc), 9) AS auroc, round(any_value(auprc), 9) AS auprc FROM preds JOIN a USING (genome) JOIN b USING (genome) GROUP BY genome")
def genome_report(spark, d):
    return metrics.group_report(L.preds(spark, d), ["genome"], "y", "score").select("genome", "n_genes", "n_essential", "scored", *_r("auroc", "auprc", to=9))


@query(f"WITH {L.PREDS}, {_RANK}, {_AP} SELECT round(avg(auroc), 9) AS mean_auroc, round(median(auroc), 9) AS median_auroc, round(avg(auprc), 9) AS mean_auprc, round(median(auprc), 9) AS median_auprc, CAST(0 AS BIGINT) AS n_excluded, count(*) AS n_scored FROM a JOIN b USING (genome)")
def macro_mean_median(spark, d):
    m = metrics.macro(metrics.group_report(L.preds(spark, d), ["genome"], "y", "score"), ["auroc", "auprc"])
    return m.select(*_r("mean_auroc", "median_auroc", "mean_auprc", "median_auprc", to=9), "n_excluded", "n_scored")


@query(f"""WITH {L.PREDS}, c AS (SELECT count(*) FILTER (prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (prob >= 0.5 AND y = 0) AS fp, count(*) FILTER (prob < 0.5 AND y = 0) AS tn, count(*) FILTER (prob < 0.5 AND y = 1) AS fn FROM preds)
  SELECT tp, fp, tn, fn, round(tp / CAST(tp + fp AS DOUBLE), 9) AS "precision", round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(tn / CAST(tn + fp AS DOUBLE), 9) AS specificity, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 9) AS accuracy FROM c""")
def confusion(spark, d):
    return metrics.confusion(L.preds(spark, d), "y", "prob").select("tp", "fp", "tn", "fn", *_r("precision", "recall", "specificity", "f1", "accuracy", to=9))


_CLF = "clf AS (SELECT o_orderstatus AS t, CASE CAST(floor(o_totalprice / 1000) AS BIGINT) % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'X' END AS p FROM orders)"


@query(f"""WITH {_CLF}, k AS (SELECT t AS c FROM clf UNION SELECT p FROM clf), f AS (SELECT c, (SELECT count(*) FROM clf WHERE t = c AND p = c) AS tp, (SELECT count(*) FROM clf WHERE t = c) AS nt, (SELECT count(*) FROM clf WHERE p = c) AS np FROM k)
  SELECT round(avg(coalesce(2 * tp / nullif(CAST(nt + np AS DOUBLE), 0), 0)), 9) AS macro_f1, round(sum(tp) / CAST(sum(nt) AS DOUBLE), 9) AS accuracy, count(*) AS n_classes FROM f""")
def macro_f1(spark, d):
    b = F.floor(F.col("o_totalprice") / 1000) % 4
    said = F.when(b == 0, "F").when(b == 1, "O").when(b == 2, "P").otherwise("X")
    return metrics.macro_f1(L.table(spark, d, "orders").withColumn("said", said), "o_orderstatus", "said").select(*_r("macro_f1", "accuracy", to=9), "n_classes")


_SPEAR = "q AS (SELECT dms_id, rna_type, rank() OVER (PARTITION BY dms_id ORDER BY dms_score) + (count(*) OVER (PARTITION BY dms_id, dms_score) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY dms_id ORDER BY model_score) + (count(*) OVER (PARTITION BY dms_id, model_score) - 1) / 2.0 AS rb FROM variants), sp AS (SELECT dms_id, rna_type, abs(corr(ra, rb)) AS spearman, count(*) AS n FROM q GROUP BY ALL)"
_SPLIT = "md AS (SELECT dms_id, median(dms_score) AS mt, median(model_score) AS ms FROM variants GROUP BY 1), hi AS (SELECT dms_id, model_score, dms_score >= mt AS t, model_score >= ms AS s FROM variants JOIN md USING (dms_id))"
_MAUC = "hr AS (SELECT dms_id, t, rank() OVER (PARTITION BY dms_id ORDER BY model_score) + (count(*) OVER (PARTITION BY dms_id, model_score) - 1) / 2.0 AS rk FROM hi), ha AS (SELECT dms_id, (sum(rk) FILTER (t) - count(*) FILTER (t) * (count(*) FILTER (t) + 1) / 2.0) / (CAST(count(*) FILTER (t) AS DOUBLE) * count(*) FILTER (NOT t)) AS auc FROM hr GROUP BY 1)"
_MCC = "hc AS (SELECT dms_id, CAST(count(*) FILTER (t AND s) AS DOUBLE) AS tp, CAST(count(*) FILTER (NOT t AND s) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT t AND NOT s) AS DOUBLE) AS tn, CAST(count(*) FILTER (t AND NOT s) AS DOUBLE) AS fn FROM hi GROUP BY 1), hm AS (SELECT dms_id, abs((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))) AS mcc FROM hc)"


@query(f"WITH {L.VARIANTS}, {_SPEAR} SELECT dms_id, round(spearman, 8) AS spearman, n AS n_variants FROM sp")
def spearman(spark, d):
    return metrics.spearman(L.variants(spark, d), ["dms_id"], "dms_score", "model_score").select("dms_id", *_r("spearman", to=8), "n_variants")


@query(f"WITH {L.VARIANTS}, {_SPLIT}, {_MAUC} SELECT dms_id, round(greatest(auc, 1 - auc), 8) AS auc FROM ha")
def median_auc(spark, d):
    return metrics.median_auc(L.variants(spark, d), ["dms_id"], "dms_score", "model_score").select("dms_id", *_r("auc", to=8))


@query(f"WITH {L.VARIANTS}, {_SPLIT}, {_MCC} SELECT dms_id, round(mcc, 8) AS mcc FROM hm")
def mcc(spark, d):
    return metrics.median_mcc(L.variants(spark, d), ["dms_id"], "dms_score", "model_score").select("dms_id", *_r("mcc", to=8))


@query(f"WITH {L.VARIANTS}, {_SPEAR}, {_SPLIT}, {_MAUC}, {_MCC} SELECT dms_id, rna_type, n AS n_variants, CAST(0 AS BIGINT) AS n_missing, round(spearman, 8) AS spearman, round(greatest(auc, 1 - auc), 8) AS auc, round(mcc, 8) AS mcc FROM sp JOIN ha USING (dms_id) JOIN hm USING (dms_id)")
def dms_report(spark, d):
    r = metrics.variant_report(L.variants(spark, d), ["dms_id", "rna_type"], "dms_score", "model_score")
    return r.select("dms_id", "rna_type", "n_variants", "n_missing", *_r("spearman", "auc", "mcc", to=8))


@query(f"WITH {L.VARIANTS}, {_SPEAR}, k AS (SELECT rna_type, avg(spearman) AS spearman FROM sp GROUP BY 1) SELECT round(avg(spearman), 8) AS spearman FROM k")
def type_mean(spark, d):
    s = metrics.spearman(L.variants(spark, d), ["dms_id", "rna_type"], "dms_score", "model_score")
    return metrics.type_mean(s, "rna_type", ["spearman"]).select(*_r("spearman", to=8))


# -- layers ---------------------------------------------------------------------------------------
_DEPTH = f"""{L.EMB}, pair AS (SELECT c.layer_id, c.item, sum(c.x * c.x) AS vv, sum(p.x * p.x) AS uu, sum(c.x * p.x) AS vu, sum((c.x - p.x) * (c.x - p.x)) AS dd FROM emb c LEFT JOIN emb p ON c.item = p.item AND c.dim = p.dim AND c.layer_id = p.layer_id + 1 GROUP BY ALL),
  h AS (SELECT layer_id, sqrt(sum(vv) / (16.0 * count(*))) AS rms, avg(vu / (sqrt(vv) * sqrt(uu))) AS cos, sqrt(sum(dd) / (16.0 * count(dd))) AS moved FROM pair GROUP BY 1),
  sd AS (SELECT layer_id, sqrt(avg(v)) AS spread FROM (SELECT layer_id, dim, var_pop(x) AS v FROM emb GROUP BY ALL) GROUP BY 1),
  dh AS (SELECT CAST(layer_id AS INTEGER) AS layer_id, rms, spread / rms AS rel_std, cos, moved / rms AS delta FROM h JOIN sd USING (layer_id))"""


def _health(spark, d):
    return vectors.depth_health(L.emb(spark, d))


@query(f"WITH {_DEPTH} SELECT layer_id, round(rms, 7) AS rms, round(rel_std, 7) AS rel_std, round(cos, 7) AS cos, round(delta, 7) AS delta, coalesce(delta <= 0.00390625, false) AS frozen, rms <= 1e-12 AS degenerate FROM dh")
def depth_health(spark, d):
    return _health(spark, d).select("layer_id", *_r("rms", "rel_std", "cos", "delta", to=7), "frozen", "degenerate")


@query(f"WITH {_DEPTH} SELECT round(delta, 7) AS ratio_min, layer_id AS ratio_min_layer FROM dh WHERE delta IS NOT NULL ORDER BY delta, layer_id LIMIT 1")
def depth_min_update(spark, d):
    return vectors.least_update(_health(spark, d)).select(F.round("ratio_min", 7).alias("ratio_min"), "ratio_min_layer")


@query("WITH l AS (SELECT DISTINCT p_size FROM part WHERE p_size % 4 <> 2), g AS (SELECT lag(p_size) OVER (ORDER BY p_size) AS after_layer, p_size AS next_layer FROM l) SELECT * FROM g WHERE next_layer - after_layer <> 1")
def layer_gaps(spark, d):
    return vectors.layer_gaps(L.table(spark, d, "part").where("p_size % 4 <> 2"), "p_size")


_SCORES = "sc AS (SELECT CAST(event_id % 6 AS INTEGER) AS layer_id, round(avg(value), 6) AS score, event_id % 6 = 3 AS degenerate FROM events GROUP BY event_id % 6)"


def _layer_scores(spark, d):
    return L.table(spark, d, "events").groupBy((F.col("event_id") % 6).cast("int").alias("layer_id")).agg(F.round(F.avg("value"), 6).alias("score"))


@query(f"WITH {_SCORES} SELECT layer_id FROM sc WHERE NOT degenerate")
def usable_layers(spark, d):
    s = _layer_scores(spark, d)
    return vectors.usable_layers(s.withColumn("degenerate", F.col("layer_id") == 3))


@query(f"WITH {_SCORES}, g AS (SELECT layer_id, score FROM sc WHERE NOT degenerate ORDER BY score DESC, layer_id LIMIT 1), n AS (SELECT layer_id FROM sc ORDER BY score DESC, layer_id LIMIT 1) SELECT g.layer_id AS best_layer, g.score AS best_score, n.layer_id AS would_have_picked, CAST(5 AS BIGINT) AS considered, CAST(1 AS BIGINT) AS excluded FROM g, n")
def best_layer(spark, d):
    s = _layer_scores(spark, d)
    return vectors.best_layer(s, s.select("layer_id", (F.col("layer_id") == 3).alias("degenerate")))


@query(f"WITH {_SCORES} SELECT concat('layer_', layer_id, '_score') AS metric, score AS value FROM sc UNION ALL SELECT 'best_layer', CAST((SELECT layer_id FROM sc ORDER BY score DESC, layer_id LIMIT 1) AS DOUBLE) UNION ALL SELECT 'score', max(score) FROM sc")
def wide_sweep(spark, d):
    s = _layer_scores(spark, d)
    found = {r.layer_id: {"score": r.score} for r in s.collect()}  # a row a layer
    _, wide = tasks.choose_layer(spark, found, None, "score")
    return spark.createDataFrame(list(wide.items()), "metric string, value double")


# -- control --------------------------------------------------------------------------------------
_CAPS = "SELECT r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 0 THEN true ELSE false END AS has_score, r_regionkey % 3 = 0 AS has_llr FROM region"


@query(f"WITH c AS ({_CAPS}) SELECT r_name AS model, task, CAST(CASE WHEN task = 'genes' THEN NULL WHEN has_llr THEN 0 WHEN has_score THEN 1 END AS INTEGER) AS chosen, CASE WHEN task = 'variants' AND (has_llr OR has_score) THEN 'ok' ELSE 'na' END AS status, CAST(CASE WHEN task = 'genes' THEN 1 WHEN has_llr OR has_score THEN 0 ELSE 1 END AS INTEGER) AS fewest_lacking FROM c, (SELECT unnest(['genes', 'variants']) AS task)")
def negotiate(spark, d):
    key = F.col("r_regionkey")
    declared = L.table(spark, d, "region").select(F.col("r_name").alias("model"), F.filter(F.array(F.when(key % 2 == 0, "score"), F.when(key % 3 == 0, "variant_llr")), lambda x: x.isNotNull()).alias("capabilities"))
    alternatives = spark.sql("SELECT 'variants' AS task, 0 AS alt, array('variant_llr') AS required UNION ALL SELECT 'variants', 1, array('score') UNION ALL SELECT 'genes', 0, array('embed')")
    return control.negotiate(alternatives, declared)


@query(f"WITH {L.RECORDS} SELECT DISTINCT model, task FROM records WHERE status <> 'ok'")
def resume_pending(spark, d):
    r = L.records(spark, d)
    return control.pending(r.select("model", "task").distinct(), r)


@query("SELECT o_custkey % 50 AS corpus, count(*) AS consumers, CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS all_layers, CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INTEGER) AS logprob, count(*) > 1 AS shared FROM orders GROUP BY 1")
def fusion_plan(spark, d):
    o = L.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("corpus"), (F.col("o_orderstatus") == "F").alias("all_layers"), (F.col("o_orderpriority") == "1-URGENT").alias("logprob"))
    return control.fusion_plan(o)


@query(f"WITH {L.SEQS} SELECT genome, substr(sha256(concat(CAST(count(*) AS VARCHAR), chr(0), string_agg(seq, chr(0) ORDER BY doc_id))), 1, 24) AS corpus_key FROM seqs GROUP BY genome")
def corpus_key(spark, d):
    return features.corpus_keys(L.seqs(spark, d), "genome", "doc_id", "seq")


# -- result tables --------------------------------------------------------------------------------
_TASKS = "tasks AS (SELECT DISTINCT event_type AS task FROM events)"


def _tasks(spark, d):
    return L.table(spark, d, "events").select(F.col("event_type").alias("task")).distinct()


@query(f"""WITH {L.RECORDS} SELECT model, task, status, max(value) FILTER (metric = 'mean') AS "metric.mean", max(value) FILTER (metric = 'size') AS "metric.size", max(value) FILTER (metric = 'top') AS "metric.top" FROM records GROUP BY ALL""")
def tidy(spark, d):
    return results.tidy(L.records(spark, d), ["mean", "size", "top"])


_HEAD = "hd AS (SELECT m.model, avg(value) AS headline, count(value) AS n_ok, count(*) AS n_tasks FROM (SELECT DISTINCT model FROM records) m CROSS JOIN tasks t LEFT JOIN (SELECT * FROM records WHERE status = 'ok' AND metric = \"primary\") r ON r.model = m.model AND r.task = t.task GROUP BY 1)"


@query(f"WITH {L.RECORDS}, {_TASKS}, {_HEAD} SELECT model, round(headline, 6) AS headline, n_ok, n_tasks FROM hd")
def headline(spark, d):
    return results.headline(L.records(spark, d), _tasks(spark, d)).withColumn("headline", F.round("headline", 6))


@query(f"WITH {L.RECORDS}, {_TASKS}, {_HEAD} SELECT model, round(headline, 6) AS headline, n_ok, n_tasks, CAST(row_number() OVER (ORDER BY headline DESC NULLS LAST, model) AS INTEGER) AS place FROM hd")
def overall_board(spark, d):
    return results.overall_board(L.records(spark, d), _tasks(spark, d)).withColumn("headline", F.round("headline", 6))


@query(f"""WITH {L.RECORDS}, w AS (SELECT model, status, max(value) FILTER (metric = 'mean') AS mean, max(value) FILTER (metric = 'size') AS size FROM records WHERE task = 'view' GROUP BY ALL)
  SELECT model, status, CASE status WHEN 'ok' THEN printf('%.4f', round(mean, 4)) WHEN 'na' THEN 'N/A' ELSE 'ERROR' END AS shown_mean, CASE status WHEN 'ok' THEN printf('%.4f', round(size, 4)) WHEN 'na' THEN 'N/A' ELSE 'ERROR' END AS shown_size,
  CAST(row_number() OVER (ORDER BY CASE WHEN status = 'ok' THEN mean END DESC NULLS LAST, model) AS INTEGER) AS place FROM w""")
def per_task_board(spark, d):
    return results.task_board(L.records(spark, d), "view", ["mean", "size"], "mean")


_LONG = """lr AS (SELECT model_id, task, CASE WHEN regexp_matches(metric, '^layer_\\d+_.+$') THEN regexp_extract(metric, '^layer_(\\d+)_(.+)$', 2) ELSE metric END AS metric, CASE WHEN regexp_matches(metric, '^layer_\\d+_.+$') THEN CAST(regexp_extract(metric, '^layer_(\\d+)_(.+)$', 1) AS INTEGER) END AS layer, metric = "primary" AS is_primary, value FROM sweeps JOIN models USING (model) WHERE status = 'ok')"""


def _reference(spark, d):
    return results.long_reference(L.sweeps(spark, d), L.models(spark, d))


@query(f"WITH {L.SWEEPS}, {L.MODELS}, {_LONG} SELECT * FROM lr")
def long_reference(spark, d):
    return _reference(spark, d)


_BEST = "lb AS (SELECT model_id, replace(task, '-layer-sweep', '') AS task, arg_max(value, layer) AS last, max(layer) AS top, max(value) AS best FROM lr WHERE layer IS NOT NULL GROUP BY ALL), tp AS (SELECT lb.*, min(lr.layer) AS tap FROM lb JOIN lr ON lr.model_id = lb.model_id AND replace(lr.task, '-layer-sweep', '') = lb.task AND lr.value = lb.best AND lr.layer IS NOT NULL GROUP BY ALL)"


@query(f"WITH {L.SWEEPS}, {L.MODELS}, {_LONG}, {_BEST} SELECT model_id, task, last, best, tap, round(tap / CAST(top AS DOUBLE), 6) AS relative_depth FROM tp")
def last_vs_best(spark, d):
    return results.last_and_best(_reference(spark, d)).withColumn("relative_depth", F.round("relative_depth", 6))


@query(f"""WITH {L.SWEEPS}, {L.MODELS}, {_LONG}, x AS (SELECT task, metric, layer, value FROM lr WHERE model_id = (SELECT min(model_id) FROM models)), y AS (SELECT task, metric, layer, value + CASE WHEN layer = 2 THEN 0.01 ELSE 0.0 END AS value FROM x WHERE layer IS NULL OR layer <> 5),
  f AS (SELECT coalesce(x.task, y.task) AS task, x.value AS a, y.value AS b FROM x FULL JOIN y ON x.task = y.task AND x.metric = y.metric AND x.layer IS NOT DISTINCT FROM y.layer)
  SELECT task, count(abs(a - b)) AS n_shared, count(*) FILTER (a = b) AS n_equal, count(*) FILTER (abs(a - b) IS NULL) AS n_missing, round(max(abs(a - b)), 6) AS worst, bool_and(coalesce(abs(a - b) <= 0.001, false)) AS passes FROM f GROUP BY task""")
def compare(spark, d):
    ref = _reference(spark, d)
    least = L.models(spark, d).agg(F.min("model_id").alias("model_id"))
    ours = ref.join(F.broadcast(least), "model_id")
    theirs = ours.where("layer IS NULL OR layer <> 5").withColumn("value", F.col("value") + F.when(F.col("layer") == 2, 0.01).otherwise(0.0))
    return results.compare(ours, theirs, F.lit(0.001), F.lit(True)).withColumn("worst", F.round("worst", 6))


_TAPS = """tv AS (SELECT event_type AS task, CAST(event_id % 12 AS INTEGER) AS layer, round(0.5 + avg(value) / 1e6, 9) AS x FROM events GROUP BY ALL),
  tc AS (SELECT task, layer, x, round(x + CASE WHEN task = 'click' OR layer <> length(task) THEN 0.0 WHEN task = 'error' THEN 0.01 ELSE 0.0003 END, 9) AS y FROM tv WHERE task <> 'purchase' OR layer <> 3),
  ts AS (SELECT tv.task, tv.layer, tv.x, tc.y, tc.task IS NOT NULL AS here FROM tv LEFT JOIN tc ON tv.task = tc.task AND tv.layer = tc.layer),
  tb AS (SELECT task, arg_max(layer, x * 1e9 - layer / 1e3) AS rt, arg_max(layer, y * 1e9 - layer / 1e3) FILTER (here) AS ct FROM ts GROUP BY 1),
  tg AS (SELECT ts.task, rt, ct, count(*) FILTER (here) + 1 AS n_shared, count(*) FILTER (x = y) + CAST(rt = ct AS BIGINT) AS n_equal, count(*) FILTER (NOT here) AS n_missing, max(abs(x - y)) AS worst, max(y) FILTER (layer = ct) - max(y) FILTER (layer = rt) AS ahead FROM ts JOIN tb USING (task) GROUP BY ts.task, rt, ct)"""


def _taps(spark, d, exact):
    layer, task = F.col("layer"), F.col("task")
    v = L.table(spark, d, "events").groupBy(F.col("event_type").alias("task"), (F.col("event_id") % 12).cast("int").alias("layer")).agg(F.round(0.5 + F.avg("value") / 1e6, 9).alias("value"))
    moved = F.when((task == "click") | (layer != F.length(task)), 0.0).when(task == "error", 0.01).otherwise(0.0003)
    ours = v.where((task != "purchase") | (layer != 3)).withColumn("value", F.round(F.col("value") + moved, 9))
    whole = lambda df: df.select("task", F.lit("score").alias("metric"), "layer", "value").unionByName(df.groupBy("task").agg(F.max_by("layer", F.struct("value", -layer)).cast("double").alias("value")).select("task", F.lit("best_layer").alias("metric"), F.lit(None).cast("int").alias("layer"), "value"))
    reference = whole(v).withColumn("is_primary", F.col("metric") == "score")
    out = results.compare_taps(reference, whole(ours), v.select("task").distinct().withColumn("tolerance", F.lit(0.001)), exact)
    return out.withColumn("worst", F.round("worst", 9))


@query(f"WITH {_TAPS} SELECT task, n_shared, n_equal, n_missing, round(worst, 9) AS worst, CAST(rt AS INTEGER) AS reference_tap, CAST(ct AS INTEGER) AS tap, rt = ct OR coalesce(ahead <= 0.001, false) AS tap_ok, (rt = ct OR coalesce(ahead <= 0.001, false)) AND n_missing = 0 AND worst <= 0.001 AS passes FROM tg")
def compare_taps(spark, d):
    """Tasks that pass as they are, by a near tie of layers, and that fail by a layer's score or a layer that lacks."""
    return _taps(spark, d, False)


@query(f"WITH {_TAPS} SELECT task, n_shared, n_equal, n_missing, round(worst, 9) AS worst, CAST(rt AS INTEGER) AS reference_tap, CAST(ct AS INTEGER) AS tap, rt = ct AS tap_ok, rt = ct AND n_missing = 0 AND worst = 0 AS passes FROM tg")
def compare_taps_exact(spark, d):
    return _taps(spark, d, True)


@query("SELECT concat('m', n_nationkey) AS model, lower(n_name) AS name, CASE WHEN n_nationkey < 9 OR n_nationkey >= 15 THEN n_name END AS model_id FROM nation")
def identify(spark, d):
    n = L.table(spark, d, "nation")
    key = F.concat(F.lit("m"), F.col("n_nationkey").cast("string"))
    known = n.select(F.when(F.col("n_nationkey") < 5, key).alias("hash"), F.when(F.col("n_nationkey").between(5, 8), key).alias("other_hash"), F.when(F.col("n_nationkey") >= 15, F.lower("n_name")).alias("display_name"), F.col("n_name").alias("model_id"))
    return results.identify(n.select(key.alias("model"), F.lower("n_name").alias("name")), known)


_FLOOR = """ks AS (SELECT event_type AS task, event_id % 6 + 1 AS k, round(avg(value), 6) AS value, CASE WHEN event_id % 6 = 2 THEN 'error' ELSE 'ok' END AS status FROM events GROUP BY ALL),
  fl AS (SELECT task, k, value AS floor FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY value DESC, k) AS r FROM ks WHERE status = 'ok') WHERE r = 1)"""


def _floors(spark, d):
    ks = L.table(spark, d, "events").groupBy(F.col("event_type").alias("task"), (F.col("event_id") % 6 + 1).alias("k")).agg(F.round(F.avg("value"), 6).alias("value"))
    return results.floor(ks.withColumn("status", F.when(F.col("k") == 3, "error").otherwise("ok")))


@query(f"WITH {_FLOOR} SELECT * FROM fl")
def kmer_floor_best_k(spark, d):
    return _floors(spark, d)


@query(f"WITH {_FLOOR} SELECT * FROM fl UNION ALL SELECT concat(task, '-layer-sweep'), k, floor FROM fl WHERE task <> 'error'")
def floor_inherit(spark, d):
    f = _floors(spark, d)
    twins = f.where("task <> 'error'").select(F.concat("task", F.lit("-layer-sweep")).alias("task"), F.col("task").alias("twin"))
    return results.inherit(f, twins)


@query(f"WITH {_FLOOR} SELECT task, k, CASE WHEN task IN ('view', 'click') THEN 0.5 ELSE floor END AS floor FROM fl")
def floor_merge(spark, d):
    f = _floors(spark, d)
    return results.merge_floors(f, f.where("task IN ('view', 'click')").withColumn("floor", F.lit(0.5)))


@query(f"WITH {L.RECORDS}, {_FLOOR} SELECT model, task, value, floor, k, round(value - floor, 6) AS headroom FROM records LEFT JOIN fl USING (task) WHERE status = 'ok' AND metric = 'mean'")
def headroom(spark, d):
    r = L.records(spark, d).where("status = 'ok' AND metric = 'mean'").select("model", "task", "value")
    return results.headroom(r, _floors(spark, d)).select("model", "task", "value", "floor", "k", F.round("headroom", 6).alias("headroom"))


@query("SELECT p_partkey, CASE WHEN p_retailprice IS NULL THEN 'N/A' ELSE printf('%.4f', round(p_retailprice, 4)) END AS shown, CASE WHEN p_partkey * 1000003 >= 1e9 THEN printf('%.2fB', round(p_partkey * 1000003 / 1e9, 2)) ELSE printf('%.1fM', round(p_partkey * 1000003 / 1e6, 1)) END AS params FROM part")
def formatting(spark, d):
    return L.table(spark, d, "part").select("p_partkey", results.shown(F.col("p_retailprice")).alias("shown"), results.params_shown(F.col("p_partkey") * 1000003).alias("params"))


@query("""WITH m AS (SELECT s_suppkey, concat('sha:', md5(s_name)) AS model, CASE WHEN s_nationkey % 3 > 0 THEN s_name WHEN s_nationkey % 2 = 0 THEN '' END AS name, CAST(s_nationkey AS VARCHAR) AS version FROM supplier)
  SELECT s_suppkey, concat(CASE WHEN coalesce(name, '') <> '' THEN concat(name, ' \u00b7 ') ELSE '' END, 'kmer@', version, ' (', substr(model, 5, 10), ')') AS label FROM m""")
def model_labels(spark, d):
    s = L.table(spark, d, "supplier")
    name = F.when(F.col("s_nationkey") % 3 > 0, F.col("s_name")).when(F.col("s_nationkey") % 2 == 0, "")
    model = F.concat(F.lit("sha:"), F.md5(F.col("s_name").cast("binary")))
    return s.select("s_suppkey", results.model_label(F.lit("kmer"), F.col("s_nationkey").cast("string"), model, name).alias("label"))


@query(f"""WITH {L.VARIANTS}, {_SPEAR}, a AS (SELECT dms_id, round(spearman, 8) AS s FROM sp) SELECT concat(dms_id, '_spearman') AS metric, s AS value FROM a
  UNION ALL SELECT 'breakout_spearman', arg_min(s, dms_id) FROM a WHERE dms_id LIKE 'A%'""")
def assay_keys(spark, d):
    s = metrics.spearman(L.variants(spark, d), ["dms_id"], "dms_score", "model_score").withColumn("spearman", F.round("spearman", 8))
    return results.assay_keys(s, "A")


@query("SELECT task, string_agg(DISTINCT m, ', ' ORDER BY m) AS methods FROM (SELECT event_type AS task, CASE WHEN event_type = 'view' OR user_id % 3 = 0 THEN 'llr' ELSE 'score' END AS m FROM events) GROUP BY task HAVING count(DISTINCT m) > 1")
def mixed_methods(spark, d):
    way = F.when((F.col("event_type") == "view") | (F.col("user_id") % 3 == 0), "llr").otherwise("score")
    return results.mixed_methods(L.table(spark, d, "events").select(F.col("event_type").alias("task"), F.lit("ok").alias("status"), way.alias("scoring_method")))


@query("SELECT p_partkey, CAST(j * 8 AS INTEGER) AS start, CAST(least(j * 8 + 8, p_size) AS INTEGER) AS \"end\", CAST(ceil(p_size / 16.0) AS INTEGER) * 16 AS padded FROM (SELECT p_partkey, p_size, unnest(range(CAST(ceil(p_size / 8.0) AS BIGINT))) AS j FROM part)")
def coarse_spans(spark, d):
    p = L.table(spark, d, "part").select("p_partkey", tensors.padded_length(F.col("p_size"), 16).alias("padded"), F.explode(tensors.coarse_spans(F.col("p_size"), 8)).alias("s"))
    return p.select("p_partkey", "s.start", "s.end", "padded")


@query(f"WITH {L.EMB} SELECT item, round(sum(x), 7) AS score_sum, round(avg(x), 8) AS score_mean FROM emb WHERE layer_id = 1 AND dim % 4 <> 0 GROUP BY item")
def logprob_reduction(spark, d):
    special = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i % 4 == 0)
    e = L.emb(spark, d).where("layer_id = 1").select("item", tensors.masked_logprobs(F.col("vec"), special).alias("z"))
    return e.select("item", F.round(tensors.reduce_logprobs(F.col("z"), "sum"), 7).alias("score_sum"), F.round(tensors.reduce_logprobs(F.col("z")), 8).alias("score_mean"))


@query(f"""WITH {L.EMB}, p AS (SELECT a.item, max(abs(a.x - b.x)) AS most, sum(a.x * a.x) AS aa, sum(b.x * b.x) AS bb, sum(a.x * b.x) AS ab FROM emb a JOIN emb b ON a.item = b.item AND a.dim = b.dim AND a.layer_id = 0 AND b.layer_id = 1 GROUP BY 1)
  SELECT item, round(most / sqrt(aa / 16.0), 6) AS rel_delta, round(ab / (sqrt(aa) * sqrt(bb)), 6) AS cosine, most / sqrt(aa / 16.0) <= 1e-5 AS same FROM p""")
def last_block_check(spark, d):
    e = L.table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = e.select("item", tensors.last_block_check(F.slice("v", 1, 16), F.slice("v", 17, 16)).alias("c"))
    return c.select("item", F.round("c.rel_delta", 6).alias("rel_delta"), F.round("c.cosine", 6).alias("cosine"), F.col("c.same").alias("same"))


@query("SELECT n_name AS model, CAST(CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 4 = 0 THEN 3 WHEN n_regionkey = 0 THEN 8 ELSE 9 END AS INTEGER) AS expected, CAST(n_nationkey % 4 AS BIGINT) AS swept, round(n_nationkey % 4 / CAST(CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey % 4 = 0 THEN 3 WHEN n_regionkey = 0 THEN 8 ELSE 9 END AS DOUBLE), 6) AS coverage FROM nation")
def sweep_coverage(spark, d):
    n = L.table(spark, d, "nation")
    key = F.col("n_nationkey")
    models = n.select(F.col("n_name").alias("model"), F.when(F.col("n_regionkey") == 0, "no-input").otherwise("other").alias("family"), F.when(key % 5 != 4, F.lit(8)).alias("n_layers"), F.when((key % 5 != 4) & (key % 4 == 0), F.lit(3)).alias("n_taps"))
    swept = n.where("n_nationkey % 4 > 0").select(F.col("n_name").alias("model"), F.explode(F.sequence(F.lit(1), (key % 4).cast("int"))).alias("layer_id"))
    return tensors.sweep_coverage(models, swept).withColumn("coverage", F.round("coverage", 6))


@query("SELECT event_type AS model FROM events GROUP BY 1 HAVING count(DISTINCT CASE event_id % 2 WHEN 0 THEN 'residual' ELSE 'branch' END) > 1")
def mixed_readouts(spark, d):
    tap = F.when(F.col("event_id") % 2 == 0, "blocks.3").otherwise("blocks.3.mlp.l2")
    return tensors.mixed_readouts(L.table(spark, d, "events").select(F.col("event_type").alias("model"), tap.alias("tap")))


# -- tasks ----------------------------------------------------------------------------------------
_GENE_RANKS = """gene AS (SELECT genome, split, essential AS y, (length(seq) - length(translate(seq, 'GC', ''))) / CAST(greatest(1, length(seq)) AS DOUBLE) AS gc FROM seqs),
  dir AS (SELECT CASE WHEN avg(gc) FILTER (y = 1) >= avg(gc) FILTER (y = 0) THEN 1 ELSE -1 END AS up FROM gene WHERE split = 'train'),
  preds AS (SELECT genome, y, gc * up AS score FROM gene, dir WHERE split = 'test')"""


@query(f"""WITH {L.LABELLED}, {_GENE_RANKS}, {_RANK}, g AS (SELECT genome FROM preds GROUP BY 1 HAVING min(y) < max(y))
  SELECT 'mean_auroc' AS metric, round(avg(auroc), 7) AS value FROM a JOIN g USING (genome) UNION ALL SELECT 'median_auroc', round(median(auroc), 7) FROM a JOIN g USING (genome)
  UNION ALL SELECT 'n_scored', CAST(count(*) AS DOUBLE) FROM g""".replace("(sum(y) * (count(*) - sum(y)))", "nullif(sum(y) * (count(*) - sum(y)), 0)"))
def gene_task(spark, d):
    return _result(spark, control.run_tasks(CodeModel(), [tasks.GeneTask("genes", lambda s: L.labelled(s, d))], spark), ["mean_auroc", "median_auroc", "n_scored"])


_UPPER = "gene AS (SELECT genome, split, essential AS y, {score} AS gc FROM seqs), dir AS (SELECT CASE WHEN avg(gc) FILTER (y = 1) >= avg(gc) FILTER (y = 0) THEN 1 ELSE -1 END AS up FROM gene WHERE split = 'train')"
_CODES = "(" + " + ".join(f"(length(seq) - length(replace(seq, '{c}', ''))) * {ord(c)}" for c in "ACGTN") + ") / (-100.0 * length(seq))"


def _auroc_of(score, up, name):
    """SQL of the mean area of genes ranked by a number, turned as the training rows say if ``up``."""
    way = "up" if up else "1"
    body = f"WITH {L.LABELLED}, {_UPPER.format(score=score)}, preds AS (SELECT genome, y, gc * {way} AS score FROM gene, dir WHERE split = 'test' AND gc IS NOT NULL), {_RANK}, g AS (SELECT genome FROM preds GROUP BY 1 HAVING min(y) < max(y)) SELECT '{name}' AS metric, round(avg(auroc), 7) AS value FROM a JOIN g USING (genome)"
    return body.replace("(sum(y) * (count(*) - sum(y)))", "nullif(sum(y) * (count(*) - sum(y)), 0)")


_GC = "(length(seq) - length(translate(seq, 'GC', ''))) / CAST(greatest(1, length(seq)) AS DOUBLE)"
_A = "(length(seq) - length(translate(seq, 'A', ''))) / CAST(greatest(1, length(seq)) AS DOUBLE)"
_N = f"(WITH {L.LABELLED} SELECT count(*) FROM seqs)"


def _shared(spark, d, own, keys):
    """metric, value of several tasks, and how many sequences the model was run on for each row."""
    calls = spark.sparkContext.accumulator(0)
    record = control.run_tasks(CountedModel(calls), own, spark)
    rows = [(f"{t['task']}_{k}", float(t["metrics"][k])) for t in record["tasks"] for k in keys if k in t["metrics"]]
    if len(rows) < len(own):
        raise ValueError(record["tasks"])
    rows += [("passes", float(len(record["passes"]))), ("calls", float(calls.value))]
    return spark.createDataFrame(rows, "metric string, value double").withColumn("value", F.round("value", 7))


@query(f"({_auroc_of(_GC, True, 'genes_mean_auroc')}) UNION ALL ({_auroc_of(_CODES, False, 'likelihood_mean_auroc')}) UNION ALL SELECT 'passes', 1.0 UNION ALL SELECT 'calls', CAST({_N} AS DOUBLE)")
def fused_heads(spark, d):
    """A probe and a likelihood task of one corpus: one pass gives both heads, a row once."""
    load = lambda s: L.labelled(s, d)
    return _shared(spark, d, [tasks.GeneTask("genes", load, "genes"), tasks.LikelihoodTask("likelihood", load, "genes")], ["mean_auroc"])


@query(f"""({_auroc_of(_GC, True, 'last_mean_auroc')}) UNION ALL ({_auroc_of(_GC, True, 'again_mean_auroc')}) UNION ALL ({_auroc_of(_A, True, 'all_layer_0_mean_auroc')}) UNION ALL ({_auroc_of(_GC, True, 'all_layer_1_mean_auroc')})
  UNION ALL ({_auroc_of(_GC.replace("seq", "substr(seq, 1, 40)"), True, 'head_mean_auroc')}) UNION ALL SELECT 'passes', 2.0 UNION ALL SELECT 'calls', CAST(2 * {_N} AS DOUBLE)""")
def reuse_passes(spark, d):
    """Four tasks of one corpus, of which one reads it cut otherwise: its windows differ, so it has a pass of its own."""
    load = lambda s: L.labelled(s, d)
    head = tasks.GeneTask("head", load, "genes")
    head.windows = lambda model: F.array(F.substring("seq", 1, 40))
    return _shared(spark, d, [tasks.GeneTask("last", load, "genes"), tasks.GeneTask("all", load, "genes", sweep=True), tasks.GeneTask("again", load, "genes"), head], ["mean_auroc", "layer_0_mean_auroc", "layer_1_mean_auroc"]).where("metric <> 'all_mean_auroc'")


_ECHO_OF = "round((" + " + ".join(f"(length(sequence) - length(replace(sequence, '{c}', ''))) * CAST({features.echo_value(ord(c))!r} AS DOUBLE)" for c in "ACGT") + ") / length(sequence), 12)"


@query(f"""WITH {L.VARIANTS.replace("variants AS", "v0 AS")}, variants AS (SELECT * REPLACE ({_ECHO_OF} AS model_score) FROM v0), {_SPEAR}, {_SPLIT}, {_MAUC}, t AS (SELECT rna_type, avg(spearman) AS s, avg(greatest(auc, 1 - auc)) AS u FROM sp JOIN ha USING (dms_id) GROUP BY 1)
  SELECT 'spearman' AS metric, round(avg(s), 7) AS value FROM t UNION ALL SELECT 'auc', round(avg(u), 7) FROM t""")
def variant_task(spark, d):
    return _result(spark, control.run_tasks(ScoreModel(), [tasks.VariantTask("variants", lambda s: L.numbered_variants(s, d))], spark), ["spearman", "auc"])


@query(f"WITH {L.ENZYMES} SELECT 'macro_f1' AS metric, 1.0::DOUBLE AS value UNION ALL SELECT 'accuracy', 1.0::DOUBLE UNION ALL SELECT 'n_classes', CAST(count(DISTINCT label) AS DOUBLE) FROM enzymes WHERE split = 'test'")
def ec_macro_f1(spark, d):
    return _result(spark, control.run_tasks(KmerModel(2), [tasks.EnzymeTask("enzymes", lambda s: L.enzymes(s, d))], spark), ["macro_f1", "accuracy", "n_classes"])


@query(f"""WITH {L.ENZYMES}, r AS (SELECT CASE WHEN row_idx % 11 = 0 THEN '' ELSE entry END AS entry, CASE WHEN row_idx % 13 = 0 THEN '' ELSE label END AS label, CASE WHEN row_idx % 17 = 0 THEN '' ELSE sequence END AS sequence FROM enzymes),
  p AS (SELECT 'empty entry' AS problem, count(*) FILTER (entry = '') AS n FROM r UNION ALL SELECT 'empty sequence', count(*) FILTER (sequence = '') FROM r UNION ALL SELECT 'empty label', count(*) FILTER (label = '') FROM r) SELECT problem, CAST(n AS BIGINT) AS n FROM p WHERE n > 0""")
def enzyme_contract(spark, d):
    blank = lambda c, k: F.when(F.col("row_idx") % k == 0, "").otherwise(F.col(c)).alias(c)
    return tables.enzyme_violations(L.enzymes(spark, d).select(blank("entry", 11), blank("label", 13), blank("sequence", 17)))


_SWEEP = f"""{L.EMB}, one AS (SELECT item, layer_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y, CASE WHEN layer_id = 2 THEN 0 ELSE x END AS x FROM emb WHERE dim = 0),
  up AS (SELECT layer_id, CASE WHEN avg(x) FILTER (y = 1) >= avg(x) FILTER (y = 0) THEN 1 ELSE -1 END AS up FROM one WHERE item % 5 <> 0 GROUP BY 1),
  r AS (SELECT layer_id, y, rank() OVER (PARTITION BY layer_id ORDER BY x * up) + (count(*) OVER (PARTITION BY layer_id, x * up) - 1) / 2.0 AS rk FROM one JOIN up USING (layer_id) WHERE item % 5 = 0),
  sc AS (SELECT layer_id, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 7) AS score FROM r GROUP BY 1)"""


@query(f"""WITH {_SWEEP} SELECT concat('layer_', layer_id, '_auroc') AS metric, score AS value FROM sc UNION ALL SELECT 'auroc', score FROM (SELECT score FROM sc WHERE layer_id <> 2 ORDER BY score DESC, layer_id LIMIT 1)
  UNION ALL SELECT 'best_layer', CAST(layer_id AS DOUBLE) FROM (SELECT layer_id FROM sc WHERE layer_id <> 2 ORDER BY score DESC, layer_id LIMIT 1)""")
def layer_sweep(spark, d):
    e = L.emb(spark, d).withColumn("vec", F.when(F.col("layer_id") == 2, F.array(F.lit(0.0))).otherwise(F.slice("vec", 1, 1)))
    rows = L.table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), (F.col("label") < 3).cast("int").alias("y"), F.lit(1).alias("all"))

    def measure(all_layers):
        out = probes.probe_all(all_layers, "y", F.col("item") % 5 != 0, tol=1e-9)
        return {r.layer_id: {"auroc": round(r.auroc, 7)} for r in metrics.auroc(out, ["layer_id"], "y", "prob").orderBy("layer_id").collect()}

    found, health = tasks.sweep(rows, e.select("item", "layer_id", "vec"), "item", measure)
    _, wide = tasks.choose_layer(spark, found, health, "auroc")
    return spark.createDataFrame(list(wide.items()), "metric string, value double")


@query("SELECT 'genes' AS task, CAST(1 AS INTEGER) AS k, CAST(1.0 AS DOUBLE) AS floor")
def floor_k1_6(spark, d):
    return results.floor(tasks.kmer_floors(spark, [tasks.GeneTask("genes", lambda s: L.rich_genes(s, d))])).select("task", "k", F.round("floor", 7).alias("floor"))

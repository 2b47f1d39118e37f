"""One object that ties catalogs, a snapshot and settings together."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.config import EngineConfig
from samefold.operators.images import query_pictures, refresh_pictures
from samefold.plans import decisions, evaluate, fingerprints, lookup, parse
from samefold.sources.catalog import Registry
from samefold.sources.embedding import EmbeddingError, EmbeddingProvider, dimension_problem, make_provider
from samefold.storage import persisted
from samefold.streaming.refresh import SnapshotStore, refresh_stream

log = logging.getLogger(__name__)


class Engine:
    def __init__(self, spark: SparkSession, registry: Registry, store: SnapshotStore, config: EngineConfig | None = None, fetch: Callable[[str], bytes] | None = None):
        """fetch gives the bytes behind a request's image_url; without it such a picture is a warning."""
        self.spark, self.registry, self.store, self.config, self.fetch = spark, registry, store, config or EngineConfig(), fetch

        self._streams: list = []
        dim = self.config.embedding.get("dim")
        if self.config.image_enabled and dim is not None and int(dim) <= 0:
            log.warning("the settings' dimension %s can't be that of a vector", dim)

    def connect(self, checkpoints: str, after: Callable[[DataFrame], None] | None = None, **trigger) -> list:
        """Start a stream for each catalog that tells its changes; a catalog that can't be read is logged and
        stays unwired. Returns the streams."""
        for kind in self.registry.kinds:
            try:
                source = self.registry.get(kind)
                if source.changes is None:
                    continue
                changes = source.changes(self.spark).withColumn("kind", F.lit(kind))
                watch = None
                if source.watch:
                    state = self.store.path + f"-watched-{kind}"
                    watch = (state, list(source.watch))
                stream = refresh_stream(changes, lambda s: self.registry.items(s), self.store, f"{checkpoints}/{kind}", watch, after)
                self._streams.append(stream.trigger(**(trigger or {"processingTime": "10 seconds"})).start())
            except (ImportError, LookupError, OSError, PySparkException, Py4JJavaError) as e:
                log.warning("changes of %s aren't followed: %s", kind, str(e)[:300])
        return self._streams

    def disconnect(self) -> None:
        while self._streams:
            self._streams.pop().stop()

    @property
    def make_provider(self) -> Callable[[], EmbeddingProvider]:
        settings = self.config.embedding
        return lambda: make_provider(settings)

    @property
    def fingerprints(self) -> DataFrame:
        return self.store.read()

    def _display(self) -> DataFrame | None:
        out = None
        for kind in self.registry.kinds:
            one = self.registry.get(kind).shown(self.spark)
            out = one if out is None else out.unionByName(one)
        return out

    def _queries(self, raw: DataFrame) -> DataFrame:
        """Parsed, with kinds that have no catalog out of scope, and `warnings` of what couldn't be used."""
        good = parse.validate(raw, self.config).where("error IS NULL").drop("error")
        pictured = query_pictures(good, self.config, self.make_provider, self.fetch)
        return persisted(self.registry.scoped(parse.parse(pictured, self.config)), "queries")

    def rejected(self, raw: DataFrame) -> DataFrame:
        """query_id and error of requests that aren't good."""
        return parse.validate(raw, self.config).where("error IS NOT NULL").select("query_id", "error")

    def search(self, raw: DataFrame) -> DataFrame:
        return lookup.search(self._queries(raw), self.fingerprints, self.config, self._display())

    def search_answers(self, raw: DataFrame) -> DataFrame:
        """One row for each good request: what was understood, its hits, and warnings."""
        queries = self._queries(raw)
        return lookup.answers(queries, lookup.search(queries, self.fingerprints, self.config, self._display()))

    def check(self, raw: DataFrame, log_path: str | None = None, source: str = "api_check", user_id: int | None = None) -> DataFrame:
        """With a log path, each candidate returned is also appended to the log, with its query."""
        return self._checked(self._queries(raw), log_path, source, user_id)

    def _checked(self, queries: DataFrame, log_path: str | None, source: str, user_id: int | None) -> DataFrame:
        out = lookup.check(queries, self.fingerprints, self.config, self._display())
        if log_path:
            out = persisted(out, "checked")  # the log and the caller read one result
            asked = queries.select("query_id", F.to_json(F.struct(*lookup.PARSED)).alias("query"))
            decisions.append(decisions.from_check(out.join(asked, "query_id"), source, user_id), log_path)
        return out

    def check_answers(self, raw: DataFrame, log_path: str | None = None, source: str = "api_check", user_id: int | None = None) -> DataFrame:
        """As search_answers, with the overall decision."""
        queries = self._queries(raw)
        found = persisted(self._checked(queries, log_path, source, user_id), "checked")
        return lookup.answers(queries, found).join(lookup.overall(queries, found), "query_id")

    def overall(self, raw: DataFrame) -> DataFrame:
        queries = self._queries(raw)
        return lookup.overall(queries, lookup.check(queries, self.fingerprints, self.config, self._display()))

    def backfill(self, kind: str | None = None, since=None) -> DataFrame:
        after, counts = fingerprints.backfill(self.fingerprints, self.registry.items(self.spark, kind, since))
        self.store.write(after)
        return counts

    def reconcile(self) -> DataFrame:
        after, counts = fingerprints.reconcile(self.fingerprints, self.registry.items(self.spark))
        rows = counts.collect()  # a row for each kind, before the snapshot changes
        self.store.write(after)
        return self.spark.createDataFrame(rows, "kind string, n_created long, n_deleted long")

    def refresh_images(self, contents: DataFrame) -> DataFrame:
        """A new snapshot with hashes and vectors of pictures (kind, ref, content) that are new, changed or
        embedded by another model; the rows written, by kind."""
        now = self.fingerprints
        found = persisted(refresh_pictures(now, contents, self.make_provider, self.config.model_id, self.config.dim), "pictures")
        self.store.write(fingerprints.set_images(now, found))
        return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n_written"))

    def evaluate(self, pairs: DataFrame, image_only: bool = False, log_path: str | None = None) -> DataFrame:
        """Outcomes of labelled pairs. With a log path the verdicts that were reached are appended to the log."""
        out = evaluate.outcomes(pairs, self.registry.items(self.spark), self.fingerprints, self.config, image_only)
        if log_path:
            out = persisted(out, "outcomes")
            decisions.append(decisions.from_outcomes(out), log_path)
        return out

    def report(self, outcomes: DataFrame, thresholds: str = "45,75") -> str:
        return evaluate.report(outcomes, evaluate.parse_thresholds(thresholds))

    def doctor(self, probe: tuple[bytes, bytes] | None = None) -> DataFrame:
        """name, ok, detail: a row for each check of the set-up. probe: two pictures that are unlike, for
        which a working backend gives unlike vectors."""
        c, kinds, versions = self.config, self.registry.kinds, self.store.versions()
        rows = [
            ("settings", not c.image_enabled or c.model_id != "none", f"pictures {'on' if c.image_enabled else 'off on purpose'}, model {c.model_id}"),
            ("thresholds", 0 < c.review_threshold <= c.match_threshold <= 100, f"{c.review_threshold}, {c.match_threshold}"),
            ("catalogs", bool(kinds), ", ".join(kinds) or "none"),
            ("snapshot", bool(versions), f"versions {versions[-3:]}"),
        ]
        here = self._backend(probe)
        rows += here
        if c.image_enabled and c.model_id != "none":  # the executors' network isn't the driver's
            try:
                settings = c.embedding
                dims = self.spark.range(1).repartition(1).mapInArrow(lambda b: _dimension(b, settings), "model string, dim int").first()
                rows.append(("worker", dims.dim == c.dim, f"answers {dims.dim} numbers, expected {c.dim}"))
            except Exception as e:  # a dead backend, a missing module and a dead executor all land here
                rows.append(("worker", False, f"no answer: {str(e)[:200]}"))
        if versions:
            n = fingerprints.coverage(self.fingerprints).collect()
            other = self.fingerprints.where((F.col("vec_model") != c.model_id) & F.col("image_vec").isNotNull()).count()
            rows.append(("coverage", True, "; ".join(f"{r.kind}: {r.n_rows} rows, {r.n_phash} hashed, {r.n_image_vec} embedded" for r in n) + f"; {other} by another model"))
            sizes = self.fingerprints.where("image_vec IS NOT NULL").agg(F.min(F.size("image_vec")).alias("a"), F.max(F.size("image_vec")).alias("b")).first()
            rows.append(("dimension", sizes.a in (None, c.dim) and sizes.b in (None, c.dim), f"vectors of {sizes.a} to {sizes.b} numbers, settings say {c.dim}"))
        return self.spark.createDataFrame(rows, "name string, ok boolean, detail string")

    def _backend(self, probe: tuple[bytes, bytes] | None) -> list[tuple[str, bool, str]]:
        if not self.config.image_enabled or self.config.model_id == "none":
            return [("provider", True, "skipped, there is no backend"), ("discrimination", True, "skipped, there is no backend")]
        try:
            provider = self.make_provider()
            info = provider.info()
            problem = dimension_problem(info, self.config.dim)
            rows = [("provider", not problem and info.model == self.config.model_id, problem or f"answers {info.model}")]
            if probe:
                a, b = (np.array(v, float) for v in provider.embed_images(list(probe)))
                norms = float(np.linalg.norm(a) * np.linalg.norm(b))
                alike = float(a @ b) / norms if norms else 1.0
                rows.append(("discrimination", alike <= MOST_ALIKE, f"unlike pictures have a cosine of {alike:.4f}"))
            return rows
        except (EmbeddingError, ValueError) as e:
            return [("provider", False, str(e))]


#: Two unlike pictures with a larger cosine than this mean that the backend doesn't look at them.
MOST_ALIKE = 0.99


def _dimension(batches, settings: dict):
    for _ in batches:
        info = make_provider(settings).info()
        yield pa.RecordBatch.from_arrays([pa.array([info.model]), pa.array([info.dim], pa.int32())], ["model", "dim"])

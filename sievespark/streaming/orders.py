"""Raw lines of orders cleaned as they come, each batch written once however often it is tried.

Two queries run over one stream of lines. The first takes lines apart, keeps those that can't be repaired and counts; it has no state. The second keeps the first arrival of
each order in Spark's state store, so that a batch costs what it brings and not what came before, and cleans what is new. A batch's results lie in folders of its number, which a
second try of the batch writes over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievespark.functions import parsers as P
from sievespark.functions import text as T
from sievespark.operators import changes, entity
from sievespark.operators.changes import LOG, Counters
from sievespark.plans import cleaning
from sievespark.plans.schema import ID_FORMATS
from sievespark.sources import lines as L

TABLE = "siparisler"


def first_arrivals(rows: DataFrame, key: Column, place: str) -> DataFrame:
    """(key, first, arrived, seen, n) of a stream's keys, for output mode update: the row that came first (of one batch that of the smallest place), when it came, when the
    key was seen last, and how often. A key is new in a batch if arrived = seen.

    A batch's time is the one that Spark keeps in the checkpoint, so a batch that is tried again finds the same; the clock mustn't go back between batches.
    """
    stamped = rows.withColumn("__now", F.current_timestamp())
    first = F.min_by(F.struct(*rows.columns), F.struct("__now", place))
    return stamped.groupBy(key.alias("key")).agg(first.alias("first"), F.min("__now").alias("arrived"), F.max("__now").alias("seen"), F.count("*").alias("n"))


@dataclass
class OrderStream:
    """Cleans a stream of lines (line_no, line) into a folder that driver and executors share.

    prices: (urun_id, birim_fiyat) and mapping: (old_id, new_id) of the merged customers are tables, read anew in each batch. line_no has to grow with the place in the input and be different for
    every line. scope, an expression over row_idx and the text columns, says what identifiers are told apart within (an export, a shop); None: they are one order wherever they come. A null line counts as one that can't be repaired. Orders without a readable identifier are one order, as in keep_first. In the folder: temiz, sorunlar, belirsiz, karantina and sayac.
    """

    folder: str
    prices: DataFrame
    mapping: DataFrame | None = None
    resolver: cleaning.Resolver = field(default_factory=cleaning.NoResolver)
    scope: Column | None = None

    def _path(self, part: str, batch: int) -> str:
        return f"{self.folder}/{part}/batch={batch}"

    def _keep(self, df: DataFrame, part: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(part, batch))

    def take_lines(self, batch: DataFrame, number: int) -> None:
        """Quarantine and counts of a batch of lines, in one job."""
        counters = Counters()
        cut = L.parsed(batch.withColumn("line", F.coalesce("line", F.lit(""))), TABLE)
        made = F.coalesce(F.size("records"), F.lit(0))
        counts = {"okunan_satir": F.sum(made), "onarilan_satir": F.sum(F.when(L.mended(TABLE), made)), "karantina": F.count_if(F.col("records").isNull())}
        self._keep(L.quarantined(counters.watched(cut, **counts), TABLE), "karantina", number)
        self._keep(counters.table(batch.sparkSession), "sayac/satir", number)

    def take_orders(self, batch: DataFrame, number: int) -> None:
        """Clean rows, entries, open cells and counts of the orders that are new in a batch. They are written down first, so that the state is asked once."""
        spark, counters = batch.sparkSession, Counters()
        self._keep(batch.where("arrived = seen").select("first.*"), "gelen", number)
        raw = spark.read.parquet(self._path("gelen", number))
        sold, open_cells = cleaning.orders(raw, self.resolver, counters)
        every = cleaning.cut(counters.actions(cleaning.completed(cleaning.priced(sold, self.prices)), TABLE))
        self._keep(changes.taken_apart(every, TABLE, "siparis_id"), "sorunlar", number)
        self._keep(open_cells.drop("row_idx"), "belirsiz", number)
        kept = every.drop(LOG)
        kept = entity.rewrite(kept, self.mapping, "musteri_id") if self.mapping is not None else kept
        self._keep(counters.watched(kept, kalan_siparis=F.count("*")), "temiz", number)
        self._keep(counters.table(spark), "sayac/siparis", number)

    def start(self, lines: DataFrame, **trigger) -> list[StreamingQuery]:
        """Both queries, started; they go on where they ended if the folder is known. trigger: as of DataStreamWriter.trigger, for instance availableNow=True."""
        records, _ = L.ingest(lines.where("line is not null"), TABLE)
        key = P.identifier(T.clean(F.col("siparis_id")), *ID_FORMATS["siparis_id"])
        key = key if self.scope is None else F.struct(self.scope.alias("scope"), key.alias("id"))
        firsts = first_arrivals(records.drop("repaired"), key, "row_idx")
        writers = [(lines.writeStream, self.take_lines, "satir"), (firsts.writeStream.outputMode("update"), self.take_orders, "siparis")]
        return [(w.trigger(**trigger) if trigger else w).foreachBatch(f).option("checkpointLocation", f"{self.folder}/durum/{name}").start() for w, f, name in writers]

    def results(self, spark: SparkSession, part: str) -> DataFrame:
        """All that the batches wrote of temiz, sorunlar, belirsiz or karantina."""
        return spark.read.parquet(f"{self.folder}/{part}").drop("batch")

    def counters(self, spark: SparkSession) -> DataFrame:
        """(name, n) over all batches; repeats are the records that aren't among the orders kept."""
        parts = [spark.createDataFrame([], "name string, n long")]
        for part in ("satir", "siparis"):
            try:
                parts.append(spark.read.parquet(f"{self.folder}/sayac/{part}").select("name", "n"))
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        gone = F.when(F.col("name") == "okunan_satir", F.col("n")).when(F.col("name") == "kalan_siparis", -F.col("n"))
        repeats = every.where("name in ('okunan_satir', 'kalan_siparis')").agg(F.lit("silinen_tekrar_siparis").alias("name"), F.coalesce(F.sum(gone), F.lit(0)).alias("n"))
        return every.groupBy("name").agg(F.sum("n").alias("n")).unionByName(repeats)

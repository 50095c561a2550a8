"""Judgements of a run, as pairs or by class.

The metrics read judgements through four methods, so that judgements that are
the same for every topic of a class need never be paired with its topics:
what the metrics hold grows with the run, the topics and the documents.
Both forms give the same rows, also where a topic or a document is named more
than once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.operators.search import class_scores


@dataclass
class PairQrels:
    """Judgements as rows ``(qid, pid, rel)``."""
    rows: DataFrame

    def judged(self, run: DataFrame) -> DataFrame:
        """The run's rows with each of their judgements (null: none) as ``rel``."""
        return run.join(self.rows.select("qid", "pid", "rel"), ["qid", "pid"], "left")

    def queries(self) -> DataFrame:
        """Every topic with a judgement, once."""
        return self.rows.select("qid").distinct()

    def counts(self) -> DataFrame:
        """Judgements of a topic and grade ``(qid, rel, n)``."""
        return self.rows.groupBy("qid", "rel").agg(F.count("*").alias("n"))

    def top_grade(self) -> DataFrame:
        return self.rows.agg(F.max("rel").alias("rel"))


@dataclass
class ClassQrels:
    """Every topic ``(qid, label)`` has as judgements all documents
    ``(pid, label, rel)`` of its label."""
    topics: DataFrame
    members: DataFrame

    def pairs(self, *more: str, parts: int = 64) -> DataFrame:
        """All judgements ``(qid, pid, rel)``, with more columns of the topics
        and documents.  A class is dealt into parts by document, so that the few
        classes spread over the tasks; each part meets all the class's topics."""
        topics = self.topics.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
        members = self.members.withColumn("_part", F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int"))
        return topics.join(members, ["label", "_part"]).select("qid", "pid", "rel", *more)

    def dots(self, topic_v: str, member_v: str, parts: int = 64) -> DataFrame:
        """``dot`` (H8) of the two vectors of every judgement ``(qid, pid,
        score)``, worked out block by block (``class_scores``)."""
        return class_scores(self.topics.withColumnRenamed(topic_v, "qv"), self.members.withColumnRenamed(member_v, "pv"), parts)

    def judged(self, run: DataFrame) -> DataFrame:
        # a topic's labels and a document's grades: one each, but where ids repeat
        labels = self.topics.groupBy("qid").agg(F.collect_list("label").alias("_labels"))
        grades = self.members.groupBy("pid").agg(F.collect_list(F.struct("label", "rel")).alias("_grades"))
        own = F.flatten(F.transform("_labels", lambda x: F.transform(
            F.filter("_grades", lambda g: g["label"] == x), lambda g: g["rel"])))
        return (run.join(labels, "qid", "left").join(grades, "pid", "left")
                   .select(*run.columns, F.explode_outer(own).alias("rel")))

    def _own_labels(self) -> DataFrame:
        return self.topics.join(self.members.select("label").distinct(), "label", "left_semi")

    def queries(self) -> DataFrame:
        return self._own_labels().select("qid").distinct()

    def counts(self) -> DataFrame:
        grades = self.members.groupBy("label", "rel").agg(F.count("*").alias("n"))
        return self.topics.join(grades, "label").groupBy("qid", "rel").agg(F.sum("n").alias("n"))

    def top_grade(self) -> DataFrame:
        return self.members.join(self.topics.select("label"), "label", "left_semi").agg(F.max("rel").alias("rel"))


Qrels = DataFrame | PairQrels | ClassQrels


def as_qrels(qrels: Qrels) -> PairQrels | ClassQrels:
    return PairQrels(qrels) if isinstance(qrels, DataFrame) else qrels

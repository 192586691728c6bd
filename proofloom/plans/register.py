"""The register of one data folder: its tables and the derived frames that queries share, all lazy."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import evidence, graph, regrade, score
from ..operators.shared import cut
from ..sources import fixture


class Register:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fixture.table(self.spark, self.sf_dir, name)

    def driver(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def observations(self) -> DataFrame:
        return evidence.build_observations(self.table("raw_observation"), self.table("document"), self.table("proposition"))

    @cached_property
    def roots(self) -> DataFrame:
        return graph.components(self.table("citation").where("collapses"))

    @cached_property
    def wide(self) -> DataFrame:
        """Written once: grading reads this table twice."""
        return self.evidence.wide(self.roots)

    @cached_property
    def first_grades(self) -> DataFrame:
        """Grades without the candidate-set path, which reads program grades."""
        return score.evaluate(self.wide)

    @cached_property
    def graded(self) -> DataFrame:
        """Not written, so that a query computes the columns it shows alone."""
        sets = score.candidate_sets(None, self.first_grades, self.table("candidate_set"))
        return score.evaluate(self.wide, cut(sets.select("candidate_set_id", "program_ok"), "sets"))

    @cached_property
    def final(self) -> DataFrame:
        return score.clamp(self.graded.select("proposition_id", "entity_id", "class", "parent_id", "grade", "awarded", "limiting", "ceiling", "marginal", "created_on", "cap_text", "null_state", "refutation"))

    @cached_property
    def evidence(self) -> regrade.Evidence:
        names = {"propositions": "proposition", "raw": "raw_observation", "documents": "document", "citations": "citation", "profiles": "profile", "witnesses": "witness", "sets": "candidate_set"}
        return regrade.Evidence(**{k: self.table(v) for k, v in names.items()})

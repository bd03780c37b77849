"""How often the facts are read: not once for each result that needs them."""

import re

from itemlab.adapters import Tables
from itemlab.operators import caches, dashboards

SF = "/root/testdata/sf0.001"


def counted(spark, facts):
    """The facts, and a counter of the rows that were read of them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return facts.mapInArrow(count, facts.schema), seen


def test_a_refresh_reads_the_facts_once(spark, tmp_path):
    t = Tables(spark, SF)
    facts, seen = counted(spark, t.facts())
    rows = t.facts().count()
    v, a = caches.Cache(spark, f"{tmp_path}/v", caches.VALIDATION), caches.Cache(spark, f"{tmp_path}/a", caches.ALIGNMENT)
    assert caches.refresh_caches(v, a, facts, t.questions(), t.topics()) == {"validation": [1, 2, 3], "alignment": [1, 2, 3]}
    assert seen.value == rows
    assert caches.refresh_caches(v, a, facts, t.questions(), t.topics()) == {"validation": [], "alignment": []}
    assert seen.value == 2 * rows


def test_the_sections_read_the_facts_once(spark):
    t = Tables(spark, SF)
    facts, seen = counted(spark, t.facts())
    sections = dashboards.section_tables(facts, t.questions(), t.topics(), t.details(), t.criteria(), t.works(), t.answers())
    for name in ("validation", "quality", "correlation", "students", "semantic"):
        assert sections[name].count() > 0
    assert seen.value == t.facts().count()


def test_a_task_of_the_charts_groups_a_bounded_number_of_facts(spark):
    """Whatever the shuffle's partitions are."""
    facts = Tables(spark, SF).facts()
    few, many = (dashboards._facts_by(facts, n) for n in (100_000, 500))
    dealt = lambda rows: max(int(n) for n in re.findall(r"Exchange hashpartitioning\(import_id#\d+, question_id#\d+L?, student_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", rows._jdf.queryExecution().executedPlan().toString()))
    assert dealt(many) == facts.count() // 500 + 1 > 4
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))

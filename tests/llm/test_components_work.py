"""Links inside a joined part are not read again."""

from __future__ import annotations

from logtally.llm.components import components


def join_rows(spark, since: int) -> int:
    """Rows that joins have made in the executions after ``since``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total = store.executionsList(), 0
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        if run <= since:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            metrics = node.metrics()
            for k in range(metrics.size() if "Join" in node.name() else 0):
                found = values.get(metrics.apply(k).accumulatorId())
                if metrics.apply(k).name() == "number of output rows" and found.isDefined():
                    total += int(found.get().replace(",", ""))
    return total


def test_links_inside_a_part_are_read_once(spark):
    # Forty groups of twelve in a chain, the links between them far from each group's smallest id.
    links = [(g * 12 + i, g * 12 + j) for g in range(40) for i in range(12) for j in range(i)]
    links += [(g * 12 + 11, g * 12 + 23) for g in range(39)]
    rows = spark.createDataFrame(links, "a long, b long").localCheckpoint()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    since = max([-1, *(runs.apply(i).executionId() for i in range(runs.size()))])
    found = components(rows).collect()
    assert {r.id: r.component for r in found} == dict.fromkeys(range(480), 0)
    # Two joins read all links; the rest are the ids, once or twice a round.
    assert join_rows(spark, since) < 2 * len(links) + 480 * 16

import random

from dataprobe.llm.graph import connected_components


def test_components(spark, rows):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (7, 3), (3, 7)]
    links += [(r.randint(2000, 2060), r.randint(2000, 2060)) for _ in range(40)]
    parent = {x: x for link in links for x in link}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = rows(connected_components(spark.createDataFrame(links, "a long, b long")))
    assert found == sorted(((i, find(i)) for i in linked), key=repr)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

"""The event log against a small model in plain Python, event by event and sweep by sweep."""

import random

import pytest
from pyspark.sql import functions as F

from engramark.operators import replay
from engramark.operators.lifecycle import DAY

SCHEMA = "i long, ts double, op string, node_id string, kind string, src string, dst string"


def log(seed, n=260):
    r = random.Random(seed)
    facts, entities = [f"f{k}" for k in range(14)], [f"e{k}" for k in range(7)]
    rows, t = [], 0.0
    for i in range(1, n + 1):
        t += r.random() * DAY
        op = r.choice(["add_node", "add_node", "add_edge", "add_edge", "add_edge", "remove_edge", "remove_edge", "query", "query", "pin"] if i % 40 == 0 else ["add_node", "add_edge", "add_edge", "remove_edge", "remove_edge", "query"])
        node = r.choice(facts + entities)
        kind = "entity" if node[0] == "e" else r.choice(["fact", "fact", "episode", "mention"])
        edge = op in ("add_edge", "remove_edge")
        rows.append((i, t, op, None if edge else node, kind if op == "add_node" else None, r.choice(facts) if edge else None, r.choice(entities) if edge else None))
    return rows


class Model:
    def __init__(self):
        self.nodes, self.edges, self.pins, self.tombs = {}, {}, set(), {}

    def apply(self, i, ts, op, node, kind, src, dst):
        if op == "add_node":
            old = self.nodes.get(node, {"in": 0, "out": 0, "last": ts, "q": 0})
            self.nodes[node] = {**old, "kind": kind, "at": ts}
        elif op == "add_edge":
            self.edges[src, dst] = self.edges.get((src, dst), 0) + 1
            self.change(src, dst, 1)
        elif op == "remove_edge" and (src, dst) in self.edges:
            self.edges[src, dst] -= 1
            if not self.edges[src, dst]:
                del self.edges[src, dst]
                self.change(src, dst, -1)
        elif op == "query" and node in self.nodes:
            self.nodes[node]["last"] = ts
            self.nodes[node]["q"] += 1
        elif op == "pin":
            self.pins.add(node)

    def change(self, src, dst, step):
        for node, side in ((src, "out"), (dst, "in")):
            if node in self.nodes:
                self.nodes[node][side] = max(0, self.nodes[node][side] + step)

    def collect(self, node, t):
        if node in self.pins:
            return
        for src, dst in [e for e in self.edges if node in e]:
            del self.edges[src, dst]
            for other, side in ((src, "out"), (dst, "in")):
                if other in self.nodes and other != node:
                    self.nodes[other][side] = max(0, self.nodes[other][side] - 1)
        del self.nodes[node]
        self.tombs.setdefault(node, []).append(t)

    def wants(self, rule, node, t):
        x = self.nodes[node]
        age, quiet = t - x["at"], t - x["last"]
        unlinked = x["kind"] == "fact" and age >= DAY and x["out"] == 0
        if rule == "fact_only":
            return unlinked
        if rule == "ref_count":
            return x["kind"] == "entity" and age >= 7 * DAY and x["in"] == 0
        if rule == "conservative_entity":
            return unlinked or x["kind"] == "entity" and x["in"] <= 0 and age >= 30 * DAY and quiet >= 60 * DAY
        if rule == "activation_decay":
            return not (quiet < 60 * DAY or x["q"] >= 3)
        if rule == "evidence_count":
            if x["kind"] not in replay.EVIDENCE or age < 30 * DAY:
                return False
            near = {b if a == node else a for a, b in self.edges if node in (a, b)}
            return any(y["kind"] in replay.EVIDENCE and y["at"] > x["at"] and near & {b if a == o else a for a, b in self.edges if o in (a, b)} & {k for k, z in self.nodes.items() if z["kind"] == "entity"} for o, y in self.nodes.items())
        if rule == "component_isolation":
            part, todo = {node}, [node]
            while todo:
                a = todo.pop()
                for e in self.edges:
                    if a in e:
                        for b in e:
                            if b not in part:
                                part.add(b)
                                todo.append(b)
            part &= set(self.nodes)
            return not part & self.pins and t - max(self.nodes[k]["last"] for k in part) > 30 * DAY and t - min(self.nodes[k]["at"] for k in part) >= 7 * DAY
        if rule == "bundle":
            return self.wants("component_isolation", node, t) and (self.wants("activation_decay", node, t) or self.wants("evidence_count", node, t))
        raise ValueError(rule)

    def sweep(self, rule, t):
        found = [n for n in self.nodes if n not in self.pins and self.wants(rule, n, t)]
        for n in found:
            self.collect(n, t)
        return found


def state(graph):
    nodes = {x["node_id"]: (x["kind"], round(x["added_at"], 3), x["in_degree"], x["out_degree"], round(x["last_access"], 3), x["query_count"]) for x in graph.nodes.collect()}
    return nodes, {(x["src"], x["dst"]): x["count"] for x in graph.edges.collect()}


def model_state(m):
    return {k: (x["kind"], round(x["at"], 3), x["in"], x["out"], round(x["last"], 3), x["q"]) for k, x in m.nodes.items()}, m.edges


@pytest.mark.parametrize("seed", [1, 2])
def test_state_after_events_in_any_order(spark, seed):
    rows = log(seed)
    m = Model()
    for row in rows:
        m.apply(*row)
    got = replay.applied(replay.empty(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(rows, SCHEMA))
    assert state(got) == model_state(m) and {x["node_id"] for x in got.pins.collect()} == m.pins


@pytest.mark.parametrize("rule", ["fact_only", "ref_count", "conservative_entity", "activation_decay", "evidence_count", "component_isolation", "bundle"])
def test_sweeps_see_what_the_last_left(spark, rule):
    rows, every = log(3, 210), 90
    survivors = {"f1", "e2", "f5"}
    m, found = Model(), []
    for row in rows:
        m.apply(*row)
        if row[0] % every == 0:
            found += m.sweep(rule, row[1])
    found += m.sweep(rule, rows[-1][1])
    run = replay.replayed(spark.createDataFrame(rows, SCHEMA), rule, every, spark.createDataFrame([(s,) for s in survivors], "node_id string"))
    assert state(run.graph) == model_state(m)
    assert sorted((x["node_id"], round(x["collected_at"], 3)) for x in run.tombstones.collect()) == sorted((n, round(t, 3)) for n, ts in m.tombs.items() for t in ts)
    assert run.counts == {"sweeps": 3, "collected": len(found), "false_collections": sum(n in survivors for n in found)}
    assert [x["node_id"] for x in replay.survivors_left(run).collect()] == sorted(k for k, x in m.nodes.items() if x["kind"] == "entity")
    assert {x["node_id"] for x in replay.missing(run, spark.createDataFrame([(s,) for s in survivors], "node_id string")).collect()} == survivors - set(m.nodes)


def test_tombstones(spark):
    tombs = spark.createDataFrame([("a", 10 * DAY, "b"), ("c", 20 * DAY, None), ("d", 30 * DAY, "e")], "node_id string, collected_at double, superseded_by string")
    asked = spark.createDataFrame([("a", 16 * DAY), ("a", 18 * DAY), ("c", 21 * DAY), ("d", 2 * DAY)], "node_id string, asked_at double")
    assert sorted((x["node_id"], x["asked_at"] / DAY) for x in replay.superseded_lookup(asked, tombs).collect()) == [("a", 16), ("d", 2)]
    left, evicted = replay.pruned(tombs, 27 * DAY)
    assert sorted(x["node_id"] for x in left.collect()) == ["c", "d"] and tombs.agg(evicted).first()["evicted"] == 1


def test_stores_as_graphs(spark):
    history = spark.createDataFrame([("m1", "ADD", 1.0), ("m1", "UPDATE", 5.0), ("m2", "ADD", 2.0), ("m2", "DELETE", 3.0), ("m3", "ADD", 4.0)], "node_id string, event string, ts double")
    hits = spark.createDataFrame([("m1", 9.0), ("m2", 9.0)], "node_id string, ts double")
    got = {x["node_id"]: (x["added_at"], x["last_access"], x["query_count"], x["in_degree"]) for x in replay.from_history(history, hits).collect()}
    assert got == {"m1": (1.0, 9.0, 1, 0), "m3": (4.0, 4.0, 0, 0)}
    nodes = lambda xs: spark.createDataFrame(xs, "node_id string, ts double")
    edges = spark.createDataFrame([("p1", "n1"), ("p1", "n1"), ("p2", "n1")], "src string, dst string")
    graph = replay.from_episodes(nodes([("n1", 1.0), ("n2", 1.0)]), nodes([("p1", 2.0), ("p2", 3.0)]), edges, edges.limit(1).withColumn("ts", F.lit(8.0)))
    got = {x["node_id"]: (x["kind"], x["in_degree"], x["out_degree"], x["last_access"], x["query_count"]) for x in graph.nodes.collect()}
    assert got == {"n1": ("entity", 2, 0, 8.0, 1), "n2": ("entity", 0, 0, 1.0, 0), "p1": ("fact", 0, 1, 8.0, 1), "p2": ("fact", 0, 1, 3.0, 0)}
    order = replay.deletion_order(graph.nodes, nodes([("n2", 0.0), ("p2", 0.0)])).orderBy("first", "place").collect()
    assert [x["node_id"] for x in order] == ["p2", "n2"]
    named = replay.document_ids(spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "k long, x string"), "k")
    assert {x["x"]: x["doc_node"] for x in named.collect()} == {"a": "doc_00000000", "b": "doc_00000001", "c": "doc_00000002"}


def test_log_is_made_once(spark):
    from engramark.plans import extended

    for query in (extended.event_state, extended.collected_graph):
        assert "l_shipdate" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

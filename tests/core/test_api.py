import pytest

from caseloom import api
from caseloom.plans.logs import requests
from caseloom.sources import xes


def test_answers(spark, tmp_path):
    log = requests(spark)
    (tmp_path / "log.xes").write_text(xes.to_xml(log))
    path = str(tmp_path / "log.xes")
    assert api.status()["status"] == "ok"
    got = api.variants(spark, path)
    assert [x["rank"] for x in got] == [1, 2, 3, 4, 5, 6] and sum(x["frequency"] for x in got) == 6
    g = api.directly_follows(spark, path)
    assert len(g["edges"]) == 16 and g["activities"][0]["frequency"] == 9 and g["startActivities"] == {"register request": 6}
    assert api.inductive_tree(spark, log)["operator"] == "SEQUENCE"
    net = api.inductive_net(spark, log, "not a number")
    assert net["name"] == "Discovered Net" and net["schemaVersion"] == "1.0" and net == api.inductive_net(spark, log)
    assert api.inductive_bpmn(spark, log)["simplicity"]["nodes"] > 8
    assert api.fitness(spark, log, net)["percentageFittingTraces"] == 1.0
    assert 0 < api.precision(spark, log, net)["precision"] <= 1
    assert api.graph_conformance(spark, log)["logFitness"] == 1.0


def test_bad_input(spark):
    for call in (lambda: api.variants(spark, None), lambda: api.fitness(spark, requests(spark), None), lambda: api.precision(spark, requests(spark), "{"), lambda: api.fitness(spark, "", {"id": "x"})):
        with pytest.raises(ValueError):
            call()

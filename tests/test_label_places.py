"""Places where terms and labels are told by the title of a topic around them."""

import pytest

from folioflow.operators import markup as M
from folioflow.sources import markup

TABLE = "<sectiondiv><table><tbody><row><entry>{}</entry><entry><p>UP b</p></entry></row></tbody></table></sectiondiv>"
BODY = (
    "<c><concept><title>Abbre<i>viation</i></title><p>UP short</p></concept>"
    "<concept><title>Fuse/relay panel description</title>" + TABLE.format("<p>UP a</p><p><b/></p><p translate='no'>UP c</p>") + "<p>UP out</p></concept>"
    "<reference><title>Bulb wattage </title><table><entry><p>UP bulb</p></entry></table><p>UP free</p></reference>"
    "<reference><title>Bulb</title><table><entry><p>UP other</p></entry></table></reference>"
    "<p>Press <uicontrol> <b>DOOR</b> </uicontrol> or <uicontrol>DOORS</uicontrol></p>"
    "<task><title> 타이어 에너지 소비 효율 등급</title><tbody><entry><p>A</p></entry></tbody>"
    "<concept><title>t</title><tbody><entry><p>B</p></entry></tbody></concept></task></c>"
)


@pytest.fixture
def nodes(spark):
    return markup.node_table(spark.createDataFrame([("d", BODY)], "doc_id string, body string"), "doc_id", "body")


def test_terms_stay_unmarked_below_titles(spark, nodes):
    rows = M.tag_node_terms(nodes, spark.createDataFrame([("UP",)], "term string"))
    assert rows.columns == nodes.columns
    got = [r.text for r in rows.where("tag = '#text'").orderBy("node_id").collect()]
    t = '<term translate="no">{}</term>'.format
    plain = ["UP short", "UP a", "UP c", "UP b", "UP bulb"]
    marked = [f"{t('UP')} out", f"{t('UP')} free", f"{t('UP')} other", t("DOOR")]
    assert [x for x in got if x in plain] == plain
    assert [x for x in got if "<term" in x] == marked
    assert "DOORS" in got and "DOOR" not in got


def test_labels_of_fuse_cells_and_excluded_titles(nodes):
    rows = M.refine_labels(nodes, ["UP"]).orderBy("node_id").collect()
    assert [r.label for r in rows if r.rule == "fuse"] == ["UP a", None]
    assert [r.rule for r in rows if r.label in ("A", "B")] == [None, "letter"]

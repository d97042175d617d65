"""The licence rules' keywords let every rule's own matches through."""

from siltworks.llm import licenses

CASES = {
    "MPL 2.0": "mpl-2", "Apache-2.0": "apache-2", "EPL-2.0 or later": "epl-2+", "CDDL 1.0": "cddl-1", "CeCILL 2.1": "cecill-2.1", "Artistic 2.0": "artistic-2",
    "SSPL 1": "sspl-1", "BUSL-1.1": "busl-1.1", "WTFPL": "wtfpl", "released into the public\ndomain": "public-domain", "all rights\nreserved": "proprietary",
    "creative\ncommons zero": "cc0", "ODC-BY 1.0": "odc-by-1", "licenced under": "unknown-license", "a 0BSD text": "bsd-0", "under GPLv3": "gpl", "beerware license": "beerware",
    "silent deploy by permission of the commons": "",
}


def test_rules_are_tried_without_the_word_license(spark):
    got = licenses.scan(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")).orderBy("doc_id").select("labels", "score").collect()
    assert [r[0] for r in got] == list(CASES.values())
    assert all((r[1] > 0) == bool(r[0]) for r in got)

"""Closed vocabularies and fixed tables of the register."""

# Ordered vocabularies; the order carries meaning.
RANKED = {"A": 7, "B": 6, "C": 5, "D": 4, "E": 3, "F": 2}
PLACE_CLASSES = ["EXIST", "EXTENT", "LOCATE", "FEATURE"]
CAUSES = ["NEW-SEARCH", "NEW-VERIFICATION", "NEW-DISCLOSURE", "RE-ANALYSIS", "SCORER-CHANGE", "TABLE-VERSION-CHANGE", "RESCORE-NOISE", "MERGE", "SPLIT"]
COUNTED_CAUSES = ["UNSOLICITED", "SOLICITED-3P"]
EXEMPT_CAUSES = ["SCORER-CHANGE", "TABLE-VERSION-CHANGE", "RESCORE-NOISE", "NEW-DISCLOSURE", "MERGE", "SPLIT"]
DRIFT_CAUSES = ["SCORER-CHANGE", "TABLE-VERSION-CHANGE", "RESCORE-NOISE"]

# Accented Latin letters and what they fold to, one to one.
FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLD_TO = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"

# Expectedness and alternative -> (sign, magnitude).
MATRIX = {
    ("E3", "A3"): ("NEUTRAL", 0), ("E3", "A2"): ("NEUTRAL", 0), ("E3", "A1"): ("SUPPORTS", 1), ("E3", "A0"): ("SUPPORTS", 3),
    ("E2", "A3"): ("NEUTRAL", 0), ("E2", "A2"): ("NEUTRAL", 0), ("E2", "A1"): ("SUPPORTS", 1), ("E2", "A0"): ("SUPPORTS", 3),
    ("E1", "A3"): ("UNDERCUTS", 1), ("E1", "A2"): ("UNDERCUTS", 1), ("E1", "A1"): ("NEUTRAL", 0), ("E1", "A0"): ("SUPPORTS", 2),
    ("E0", "A3"): ("UNDERCUTS", 3), ("E0", "A2"): ("UNDERCUTS", 3), ("E0", "A1"): ("UNDERCUTS", 2), ("E0", "A0"): ("NEUTRAL", 0),
}
CUT_DATE = "2022-11-30"

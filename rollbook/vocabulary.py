"""Fixed names and values shared by all modules.

Results are compared with the original system by these names, so they are stated
here as plain values and must not be changed.
"""

# Column names
INDEX = "studentid"
LABEL = "target"
PROBA_0 = "preds_proba_0"
PROBA_1 = "preds_proba_1"
PREDICTION = "preds"
LABEL_TEXT = {0: "notdropout", 1: "dropout"}

# Column groups with rules attached
GROUP_DAYS = "all_attendances"
GROUP_SCORES = "exam_score_subwise"
GROUP_EXAM_ATTENDANCE = "exam_attnd_subwise"
GROUP_MONTH_ATTENDANCE = "month_agg_attnd"

# Contract types
STRING = "string"
INT = "int"
FLOAT = "float"

# Day statuses
ABSENT = "a"
MISSING = "m"
PRESENT = "p"
STATUSES = ("a", "m", "p")
STATUS_NAMES = {"absent": "a", "missing": "m", "present": "p"}
DAY_COLUMN = r"^(\d+)_(\d+)$"

# Months in academic-year order
MONTHS = (6, 7, 8, 9, 10, 11, 12, 1, 2, 3, 4, 5)

# Defaults of the sequence features
MONTH_GROUPS = {"full": (6, 7, 8, 9, 10, 11, 12, 1, 2, 3, 4, 5)}
BINARY_MONTHS = (12, 1, 2, 3, 4)
ABSENCE_THRESHOLDS = (10, 15, 20, 30, 40, 50, 60)
CHAR_COMBINATIONS = ((1, ("a", "m", "p")),)
PARTITIONS = (3,)
MAX_MISSING = 1.0

# Evaluation defaults
CALIBRATION_BINS = 20
RECALL_POINTS = 1000
HISTOGRAM_BINS = 50
SWEEP_POINTS = 100
F1_EPS_MODEL = 1e-8
F1_EPS_EVALUATION = 1e-10

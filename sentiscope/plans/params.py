"""Parameters of the registered queries (the panels' time pickers and job settings).

The day and run ranges stand for the panels' time pickers over the fixture data.
"""

DAY_LO = "2024-01-08"
DAY_HI = "2024-01-21"
RUN_LO = "2024-01-05 00:00:00"
RUN_HI = "2024-01-25 23:59:59"
# Review threshold and queue length, panel row limits, split seed and
# shares, token length of the classifier input.
REVIEW_THRESHOLD = 0.8
REVIEW_LIMIT = 50
TOP_NEGATIVE = 10
TOP_RUNS = 10
LAST_DAYS = 7
SPLIT_SEED = 42
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
MAX_LENGTH = 128
KEYWORDS = ("the", "que", "der")
WEIGHTS_TEXT = "2,1,3"
# Accuracies that the training query asks of a model: the fixed one, and one that any model passes.
GATES = (0.9, 0.0)

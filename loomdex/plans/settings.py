"""Parameters that the queries and their SQL share."""

SHARDS = 4
FLUSH_AT = 64
MERGE_RATIO = 0.1
FIRST_STAGE = 1000
FOREIGN = 500_000  # what is added to deleted ids to get others that no segment holds
DEADLINE_S = 600.0
SEEKS = [("the", 10), ("the", 100), ("and", 57), ("de", 150), ("the", 2_000_000_000)]

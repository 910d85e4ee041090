from featurelab.sources.tables import read_table, normalise_nan, numeric_columns  # noqa: F401
from featurelab.sources.store import write_stage, read_stage, stage_exists, memoised_stage  # noqa: F401

from puspark.sources.shared import materialise, workspace
from puspark.sources.tables import document_features, quantity_predictions, read_table, tuning_predictions

__all__ = ["materialise", "workspace", "read_table", "quantity_predictions", "tuning_predictions", "document_features"]

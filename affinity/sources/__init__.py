"""Input loaders, the test-data mapping and the table writers."""
from .inputs import Inputs, ItemTags, label_column, load_history, load_inputs, load_item_tags, load_profile

__all__ = ["Inputs", "ItemTags", "label_column", "load_history", "load_inputs",
           "load_item_tags", "load_profile"]

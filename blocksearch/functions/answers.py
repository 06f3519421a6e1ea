"""What services answer, as column expressions over their JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The paths of the answers of local and cloud services.
EMBEDDING = ("$.embedding", "$.data[0].embedding")
TEXT = ("$.response", "$.choices[0].message.content")


def embedding(answer: Column, cloud: bool) -> Column:
    """The vector of an answer; null if there is none."""
    return F.from_json(F.get_json_object(answer, EMBEDDING[cloud]), "array<double>")


def text(answer: Column, cloud: bool) -> Column:
    """The text of an answer; null if there is none."""
    return F.get_json_object(answer, TEXT[cloud])

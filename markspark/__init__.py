"""markspark: text-mark restoration and corpus quality on Spark DataFrames."""

from markspark.language import ROMANIAN, MarkProfile
from markspark.settings import Settings

__all__ = ["ROMANIAN", "MarkProfile", "Settings"]

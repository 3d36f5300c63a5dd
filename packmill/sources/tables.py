"""Tables as corpora: any rows with a project, a path and text or bytes."""

from pyspark.sql import Column, DataFrame, functions as F


def files_from_table(df: DataFrame, project: Column, path: Column, content: Column) -> DataFrame:
    """files(project_id, rel_path, content); text is taken as UTF-8."""
    return df.select(project.cast("string").alias("project_id"), path.alias("rel_path"),
                     content.cast("binary").alias("content"))


def url_location(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment."""
    return F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")

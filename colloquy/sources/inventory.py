"""File inventory of the user folders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DOCUMENT_MIME


def _in_folders(inventory: DataFrame, folders: DataFrame, how: str) -> DataFrame:
    wanted = folders.select(F.col("user_folder_id").alias("parent_id")).distinct()
    return inventory.join(wanted, "parent_id", how)


def list_transcripts(
    inventory: DataFrame,
    folders: DataFrame,
    mime: str = DOCUMENT_MIME,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Documents of the given folders that are not in the bin: ``id, name, parent_id, *keep``."""
    live = inventory.where((F.col("mime_type") == mime) & ~F.col("trashed"))
    return _in_folders(live, folders, "left_semi").select(
        "id", "name", "parent_id", *keep
    )


def inventory_report(inventory: DataFrame, folders: DataFrame) -> DataFrame:
    """All files of the folders that are not in the bin, with owners and permissions as text.

    An owner without an address makes the listing of that file invalid: ``owners`` is null
    and ``listing_error`` is true, and the other files are still listed.
    """
    live = _in_folders(inventory.where(~F.col("trashed")), folders, "left_semi")
    owners = F.coalesce(F.transform("owners", lambda o: o["emailAddress"]), F.array())
    bad_owner = F.exists(owners, lambda o: o.isNull())
    permissions = F.transform(
        "permissions",
        lambda p: F.concat(
            F.coalesce(p["role"], F.lit("")), F.lit(":"), F.coalesce(p["emailAddress"], F.lit(""))
        ),
    )
    return live.select(
        "id",
        "name",
        "mime_type",
        F.when(~bad_owner, F.array_join(owners, ",")).alias("owners"),
        F.coalesce(F.array_join(permissions, ","), F.lit("")).alias("perms"),
        bad_owner.alias("listing_error"),
    )

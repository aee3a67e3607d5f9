from .jdbc import jdbc_source
from .tables import load
from .upload import upload_table

__all__ = ["jdbc_source", "load", "upload_table"]

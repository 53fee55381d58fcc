"""parlance: transcript analytics expressed as Spark plans."""

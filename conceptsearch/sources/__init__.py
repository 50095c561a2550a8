"""Sources and sinks: the reference's text formats, vector shards, the index."""

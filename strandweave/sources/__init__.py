"""Sources and sinks: probed media metadata, text files, catalogues, feature checkpoints, maps and traces."""

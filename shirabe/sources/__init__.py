"""Where texts come from: files of any encoding, patches, tables, configuration."""

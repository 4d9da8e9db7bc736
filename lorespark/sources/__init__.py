"""Tables, files and keyed writes."""

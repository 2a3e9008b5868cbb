"""Log-type registry: detectors and field parsers as data, compiled to column expressions."""

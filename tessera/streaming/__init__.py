"""Online forms: windowed counts with watermarks, sessions, and detectors with keyed state."""

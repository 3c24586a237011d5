"""Files in and out: text lines, fixed-width text and binary records, bytes."""

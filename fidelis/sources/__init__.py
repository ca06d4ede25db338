"""Scans and sinks: CSV, header text, byte tokens, bit rows, pcap."""

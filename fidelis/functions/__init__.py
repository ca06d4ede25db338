"""Column expressions: addresses, bits, packet bytes and field codecs. All stay in the JVM."""

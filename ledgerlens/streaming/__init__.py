"""No operator of this library is a stream; every input is a bounded table."""

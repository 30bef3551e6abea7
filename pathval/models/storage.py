@inline
def GasStorage(start, end, name, quantity, limit, step):
    Stored(name, start, end, step, quantity, limit, 1, -1)


@inline
def GasStorageToTarget(start, end, name, quantity, target, limit, step, slew):
    Stored(name, start, end, step, quantity, limit, slew, target)


def Stored(name, day, end, step, level, room, lot, target):
    if day < end and room > 0:
        Wait(day, Choice(
            After(0, name, day, end, step, level, room, lot, target),
            After(Min(lot, Max(room - level, 0)), name, day, end, step, level, room, lot, target),
            After(-Min(lot, Max(level, 0)), name, day, end, step, level, room, lot, target)
        ))
    else:
        Closing(Max(level - target, target - level), target)


@inline
def After(amount, name, day, end, step, level, room, lot, target):
    Stored(name, day + step, end, step, level + amount, room, lot, target) - amount * Market(name)


@inline
def Closing(miss, target):
    0 if target < 0 or miss == 0 else Breach()


@inline
def Breach():
    -10 ** 16

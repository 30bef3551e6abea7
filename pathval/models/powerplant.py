def PowerPlant(day, end, power, gas, idle, step):
    Wait(day, Choice(
        PowerPlant(day + step, end, power, gas, 0, step) + Margin(day + step, power, gas, idle),
        PowerPlant(day + step, end, power, gas, Min(idle + 1, 2), step)
    )) if day < end else 0


@inline
def Margin(delivery, power, gas, idle):
    Efficiency(idle) * ForwardMarket(delivery, power) - ForwardMarket(delivery, gas)


# 1.0 after a day of running, 0.6 after one day idle, 0.3 after two.
@inline
def Efficiency(idle):
    1.0 - 0.4 * Min(idle, 1) - 0.3 * Max(idle - 1, 0)


def RunningPlant(day, end, name, idle, step):
    Wait(day, Choice(
        RunningPlant(day + step, end, name, 0, step) + (1 - idle / 10) * Market(name),
        RunningPlant(day + step, end, name, Min(idle + 1, 2), step)
    )) if day < end else 0
